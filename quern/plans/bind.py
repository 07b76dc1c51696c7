"""The driver's tables as the engine's canonical tables, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.tables import load

#: A fixed present for everything that expires, in milliseconds.
NOW_MS = 1705276800000


def ms(col: str = "ts") -> Column:
    """Milliseconds of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def events(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").withColumn("ms", ms())


def parts(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "part")
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"))


PARTS = "(SELECT 'part:' || p_partkey AS key, p_name AS value FROM part)"


def lists(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return load(s, d, "events").select(F.col("user_id").alias("key"), n.cast("long").alias("pos"), F.col("event_id").alias("value"))


LISTS = "(SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id AS value FROM events)"


def hash_writes(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), "value", F.struct("ts", "event_id").alias("seq"))


def hashes(s: SparkSession, d: str) -> DataFrame:
    from quern.operators.hashes import hset

    return hset(hash_writes(s, d))


HASHES = "(SELECT user_id AS key, event_type AS field, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL)"


def sets(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).distinct()


SETS = "(SELECT DISTINCT l_suppkey AS key, l_partkey AS member FROM lineitem)"


def zsets(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").cast("string").alias("member"), F.col("c_acctbal").alias("score"))


ZSETS = "(SELECT c_nationkey AS key, c_custkey::VARCHAR AS member, c_acctbal AS score FROM customer)"


def bits(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("bit")).distinct()


BITS = "(SELECT DISTINCT event_type AS key, user_id AS bit FROM events)"


def items(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("item"))


def series(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select(F.col("event_type").alias("key"), F.col("ms").alias("ts"), "value", F.col("event_id").alias("seq"))


SERIES = "(SELECT event_type AS key, (epoch_us(ts) // 1000) AS ts, value, event_id AS seq FROM events)"


def stream(s: SparkSession, d: str) -> DataFrame:
    from quern.operators.streams import auto_ids

    return auto_ids(events(s, d).select(F.col("event_type").alias("key"), "ms", F.col("event_id").alias("arrival"), "user_id"))


STREAM = """(SELECT event_type AS key, event_id AS arrival, user_id,
  (epoch_us(ts) // 1000)::VARCHAR || '-' || (row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) ORDER BY event_id) - 1) AS id FROM events)"""


def geo(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon = F.round(F.pmod(k * F.lit(37.123457), F.lit(360.0)) - 180, 6)
    lat = F.round(F.pmod(k * F.lit(17.654321), F.lit(170.0)) - 85, 6)
    return load(s, d, "supplier").select(F.lit("suppliers").alias("key"), k.cast("string").alias("member"), lon.alias("lon"), lat.alias("lat"))


GEO = "(SELECT 'suppliers' AS key, s_suppkey::VARCHAR AS member, round(s_suppkey * 37.123457::DOUBLE % 360 - 180, 6) AS lon, round(s_suppkey * 17.654321::DOUBLE % 170 - 85, 6) AS lat FROM supplier)"


def vectors(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("insert_order"), "embedding")


def log(s: SparkSession, d: str) -> DataFrame:
    """A command log: signup sets, click and view add, error deletes, purchase appends."""
    op = F.create_map(*map(F.lit, ("signup", "SET", "click", "INCR", "view", "INCR", "error", "DEL", "purchase", "APPEND")))
    return events(s, d).select(F.struct("ts", "event_id").alias("seq"), "event_id", F.col("user_id").alias("key"), op[F.col("event_type")].alias("op"), F.floor("value").cast("long").alias("n"), (F.col("user_id") % 2).cast("int").alias("db"), "ms", "value", "event_type")


LOG = """(SELECT (ts, event_id) AS seq, event_id, user_id AS key, CASE event_type WHEN 'signup' THEN 'SET' WHEN 'click' THEN 'INCR' WHEN 'view' THEN 'INCR'
  WHEN 'error' THEN 'DEL' ELSE 'APPEND' END AS op, floor(value)::BIGINT AS n, (user_id % 2)::INT AS db, (epoch_us(ts) // 1000) AS ms, value, event_type FROM events)"""
