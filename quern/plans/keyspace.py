"""Queries of keyspace scans and expiry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import keyspace as ks
from quern.plans import bind as b
from quern.plans.registry import add
from quern.sources.tables import load


def _customers(s, d):
    """Customers as keys of two databases, that expire where the balance is below zero."""
    c = load(s, d, "customer")
    due = F.when(F.col("c_acctbal") < 3000, F.timestamp_millis(F.lit(b.NOW_MS) + F.floor(F.col("c_acctbal") * 1000).cast("long")))
    return c.select((F.col("c_custkey") % 2).cast("int").alias("db"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("type"), due.alias("expire_at"), "c_custkey")


CUSTOMERS = f"""(SELECT (c_custkey % 2)::INT AS db, c_name AS key, c_mktsegment AS type, c_custkey,
  CASE WHEN c_acctbal < 3000 THEN {b.NOW_MS} + floor(c_acctbal * 1000)::BIGINT END AS due FROM customer)"""
NOW = F.timestamp_millis


def now():
    return F.timestamp_millis(F.lit(b.NOW_MS))


def _wanted(s, d, *cols):
    """Names of every third customer, and as many that don't exist."""
    c = load(s, d, "customer").where("c_custkey % 3 = 0")
    return c.select(F.explode(F.array("c_name", F.concat(F.lit("no:"), F.col("c_custkey").cast("string")))).alias("key"))


WANTED = "(SELECT unnest([c_name, 'no:' || c_custkey]) AS key FROM customer WHERE c_custkey % 3 = 0)"


def _names(s, d):
    """Every fifth part moves to the name of the part after it, every seventh to a new name."""
    p = load(s, d, "part")
    to = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("part:"), (F.col("p_partkey") + 1).cast("string"))).otherwise(F.concat(F.lit("new:"), F.col("p_partkey").cast("string")))
    return p.where("p_partkey % 5 = 0 OR p_partkey % 35 = 2").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("src"), to.alias("dst"))


NAMES = "(SELECT 'part:' || p_partkey AS src, CASE WHEN p_partkey % 5 = 0 THEN 'part:' || (p_partkey + 1) ELSE 'new:' || p_partkey END AS dst FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 35 = 2)"

add(
    "ks_keys_glob",
    lambda s, d: ks.keys(_customers(s, d), "Customer#*7?").select("key"),
    "SELECT c_name AS key FROM customer WHERE c_name GLOB 'Customer#*7?'",
)
add(
    "ks_scan_page",
    lambda s, d: ks.scan(_customers(s, d), "key", cursor=20, count=10, match="Customer#*5").select("key"),
    "SELECT c_name AS key FROM customer WHERE c_name LIKE 'Customer#%5' ORDER BY 1 LIMIT 10 OFFSET 20",
)
add(
    "ks_hscan",
    lambda s, d: ks.scan_each(b.hashes(s, d), "key", "field", cursor=1, count=2),
    f"SELECT * FROM {b.HASHES} AS h QUALIFY row_number() OVER (PARTITION BY key ORDER BY field) BETWEEN 2 AND 3",
)
add(
    "ks_sscan",
    lambda s, d: ks.scan_each(b.sets(s, d), "key", "member", cursor=10, count=10),
    f"SELECT * FROM {b.SETS} AS t QUALIFY row_number() OVER (PARTITION BY key ORDER BY member) BETWEEN 11 AND 20",
)
add(
    "ks_zscan",
    lambda s, d: ks.scan_each(b.zsets(s, d), "key", "score", "member", count=10),
    f"SELECT * FROM {b.ZSETS} AS t QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) <= 10",
)
add(
    "ks_dbsize",
    lambda s, d: ks.dbsize(ks.live(_customers(s, d), now())),
    f"SELECT db, count(*) AS n_keys FROM {CUSTOMERS} AS c WHERE due IS NULL OR due > {b.NOW_MS} GROUP BY db",
)
add(
    "ks_randomkey",
    lambda s, d: ks.random_key(_customers(s, d), 42).join(_customers(s, d), "key").agg(F.count("*").alias("n_known")),
    "SELECT 1::BIGINT AS n_known",
)
add(
    "ks_type",
    lambda s, d: ks.type_of(_customers(s, d), _wanted(s, d)),
    f"SELECT w.key, coalesce(c.type, 'none') AS type FROM {WANTED} AS w LEFT JOIN {CUSTOMERS} AS c USING (key)",
)
add(
    "ks_exists",
    lambda s, d: ks.exists(_customers(s, d), _wanted(s, d)),
    f"SELECT count(*) AS n_exists FROM {WANTED} AS w WHERE key IN (SELECT c_name FROM customer)",
)
add(
    "ks_del",
    lambda s, d: ks.delete(_customers(s, d), _wanted(s, d)).select("db", "key"),
    f"SELECT db, key FROM {CUSTOMERS} AS c WHERE key NOT IN (SELECT key FROM {WANTED} AS w)",
)
add("ks_rename", lambda s, d: ks.rename(b.parts(s, d), _names(s, d)), f"""
WITH m AS (SELECT src, dst FROM {NAMES} AS n WHERE src <> dst)
SELECT coalesce(dst, key) AS key, value FROM {b.PARTS} AS p LEFT JOIN m ON key = src WHERE key NOT IN (SELECT dst FROM m)""")
add("ks_renamenx", lambda s, d: ks.rename(b.parts(s, d), _names(s, d), only_new=True), f"""
WITH m AS (SELECT src, dst FROM {NAMES} AS n WHERE dst NOT IN (SELECT key FROM {b.PARTS} AS p))
SELECT coalesce(dst, key) AS key, value FROM {b.PARTS} AS p LEFT JOIN m ON key = src""")
add("ks_flushdb", lambda s, d: ks.flush(_customers(s, d), 1).select("db", "key"), f"SELECT db, key FROM {CUSTOMERS} AS c WHERE db <> 1")
add("ks_flushall", lambda s, d: ks.flush(_customers(s, d)).agg(F.count("*").alias("n_keys")), "SELECT 0::BIGINT AS n_keys")
add("ks_select_db", lambda s, d: ks.select_db(_customers(s, d), 1).select("key"), f"SELECT key FROM {CUSTOMERS} AS c WHERE db = 1")
add(
    "ttl_live",
    lambda s, d: ks.live(_customers(s, d), now()).select("key"),
    f"SELECT key FROM {CUSTOMERS} AS c WHERE due IS NULL OR due > {b.NOW_MS}",
)
add("ttl_remaining", lambda s, d: ks.ttl(_customers(s, d), _wanted(s, d), now()), f"""
SELECT w.key, CASE WHEN c.key IS NULL THEN -2 WHEN due IS NULL THEN -1 ELSE ceil((due - {b.NOW_MS}) / 1000)::BIGINT END AS ttl
FROM {WANTED} AS w LEFT JOIN (SELECT * FROM {CUSTOMERS} AS x WHERE due IS NULL OR due > {b.NOW_MS}) AS c USING (key)""")
add("ttl_pttl", lambda s, d: ks.ttl(_customers(s, d), _wanted(s, d), now(), 1), f"""
SELECT w.key, CASE WHEN c.key IS NULL THEN -2 WHEN due IS NULL THEN -1 ELSE due - {b.NOW_MS} END AS ttl
FROM {WANTED} AS w LEFT JOIN (SELECT * FROM {CUSTOMERS} AS x WHERE due IS NULL OR due > {b.NOW_MS}) AS c USING (key)""")
add(
    "ttl_expire",
    lambda s, d: ks.touch_expiry(_customers(s, d), load(s, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_name").alias("key"), (F.col("c_custkey") % 3 * 1000).alias("ttl_ms")), now()).select("key", F.unix_millis("expire_at").alias("due_ms")),
    f"""
SELECT key, CASE WHEN c_custkey % 4 = 0 THEN {b.NOW_MS} + c_custkey % 3 * 1000 ELSE due END AS due_ms FROM {CUSTOMERS} AS c WHERE NOT (c_custkey % 4 = 0 AND c_custkey % 3 = 0)""",
)
add(
    "ttl_persist",
    lambda s, d: ks.persist(_customers(s, d), _wanted(s, d)).select("key", F.col("expire_at").isNull().alias("lasting")),
    f"SELECT key, due IS NULL OR c_custkey % 3 = 0 AS lasting FROM {CUSTOMERS} AS c",
)
