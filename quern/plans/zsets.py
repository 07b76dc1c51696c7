"""Queries of sorted sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import zsets as z
from quern.plans import bind as b
from quern.plans.registry import add
from quern.sources.tables import load

UP = "row_number() OVER (PARTITION BY key ORDER BY score, member) - 1"
DOWN = "row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1"


def _writes(s, d):
    return load(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"), F.struct("ts", "event_id").alias("seq"))


def _probes(s, d):
    return load(s, d, "customer").select(F.col("c_nationkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("none").alias("member")).distinct()


add(
    "zset_zadd",
    lambda s, d: z.zadd(_writes(s, d)),
    "SELECT event_type AS key, user_id::VARCHAR AS member, arg_max(value, (ts, event_id)) AS score FROM events GROUP BY 1, 2",
)
add(
    "zset_zrem",
    lambda s, d: z.zrem(b.zsets(s, d), b.zsets(s, d).where("score < 0")),
    f"SELECT key, member, score FROM {b.ZSETS} AS z WHERE score >= 0",
)
add(
    "zset_zincrby",
    lambda s, d: z.zincrby(load(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("inc"))).withColumn("score", F.round("score", 4)),
    "SELECT event_type AS key, user_id::VARCHAR AS member, round(sum(value), 4) AS score FROM events GROUP BY 1, 2",
)
add("zset_zscore", lambda s, d: z.zscore(b.zsets(s, d), _probes(s, d)), f"""
WITH p AS (SELECT DISTINCT c_nationkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'none' END AS member FROM customer)
SELECT p.key, p.member, z.score FROM p LEFT JOIN {b.ZSETS} AS z ON p.key = z.key AND p.member = z.member""")
add("zset_zcard", lambda s, d: z.zcard(b.zsets(s, d)), "SELECT c_nationkey AS key, count(*) AS n_members FROM customer GROUP BY 1")
add("zset_zrank", lambda s, d: z.zrank(b.zsets(s, d)), f"SELECT key, member, {UP} AS rank FROM {b.ZSETS} AS z")
add("zset_zrevrank", lambda s, d: z.zrank(b.zsets(s, d), True), f"SELECT key, member, {DOWN} AS rank FROM {b.ZSETS} AS z")
add(
    "zset_zrange_topk",
    lambda s, d: z.zrange(b.zsets(s, d), 0, 9, True),
    f"SELECT key, member, score, {DOWN} AS rank FROM {b.ZSETS} AS z QUALIFY {DOWN} <= 9",
)
add(
    "zset_zrange",
    lambda s, d: z.zrange(b.zsets(s, d), 1, -3),
    f"SELECT key, member, score, {UP} AS rank FROM {b.ZSETS} AS z QUALIFY {UP} >= 1 AND {UP} <= count(*) OVER (PARTITION BY key) - 3",
)
add(
    "zset_zrevrange",
    lambda s, d: z.zrange(b.zsets(s, d), 2, 5, True),
    f"SELECT key, member, score, {DOWN} AS rank FROM {b.ZSETS} AS z QUALIFY {DOWN} BETWEEN 2 AND 5",
)
add(
    "zset_zrangebyscore",
    lambda s, d: z.zrangebyscore(b.zsets(s, d), 1000.0, 5000.0),
    f"SELECT key, member, score FROM {b.ZSETS} AS z WHERE score BETWEEN 1000 AND 5000",
)
add("zset_zpopmin", lambda s, d: z.zpop(b.zsets(s, d), 3)[0], f"SELECT key, member FROM {b.ZSETS} AS z QUALIFY {UP} < 3")
add("zset_zpopmin_rest", lambda s, d: z.zpop(b.zsets(s, d), 3)[1], f"SELECT key, member, score FROM {b.ZSETS} AS z QUALIFY {UP} >= 3")
add("zset_zpopmax", lambda s, d: z.zpop(b.zsets(s, d), 0, True)[0], f"SELECT key, member FROM {b.ZSETS} AS z QUALIFY {DOWN} < 1")
