"""Queries of string values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import commandlog as cl
from quern.operators import strings as st
from quern.plans import bind as b
from quern.plans.keyspace import now
from quern.plans.registry import add
from quern.sources.tables import load


def _requested(s, d):
    p = load(s, d, "part")
    return p.select(F.col("p_partkey").alias("pos"), F.concat(F.when(F.col("p_partkey") % 2 == 1, F.lit("part:")).otherwise(F.lit("none:")), F.col("p_partkey").cast("string")).alias("key"))


def _writes(s, d):
    return load(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("seq"), "event_id", F.floor("value").cast("long").alias("ttl_s"))


def _docs(s, d):
    return load(s, d, "documents").select("doc_id", "text")


def _pairs(s, d):
    """New values for some parts and some new keys, each in a transaction."""
    return load(s, d, "part").where("p_partkey % 4 = 0").select(F.concat(F.when(F.col("p_partkey") % 8 == 0, F.lit("part:")).otherwise(F.lit("new:")), F.col("p_partkey").cast("string")).alias("key"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 16).alias("txn"))


PAIRS = "(SELECT CASE WHEN p_partkey % 8 = 0 THEN 'part:' ELSE 'new:' END || p_partkey AS key, p_brand AS value, p_partkey % 16 AS txn FROM part WHERE p_partkey % 4 = 0)"

add("str_get", lambda s, d: st.get(b.parts(s, d), "part:7").select("value"), "SELECT p_name AS value FROM part WHERE p_partkey = 7")
add(
    "str_mget",
    lambda s, d: st.mget(b.parts(s, d), _requested(s, d)),
    "SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 1 THEN 'part:' ELSE 'none:' END || p_partkey AS key, CASE WHEN p_partkey % 2 = 1 THEN p_name END AS value FROM part",
)
add(
    "str_set_lww",
    lambda s, d: st.set_last(_writes(s, d)),
    "SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1",
)
add(
    "str_setnx",
    lambda s, d: st.set_if_absent(_writes(s, d)),
    "SELECT user_id AS key, arg_min(event_type, (ts, event_id)) AS value FROM events GROUP BY 1",
)
add(
    "str_set_xx",
    lambda s, d: st.set_if_present(st.set_if_absent(_writes(s, d).where("event_id % 7 = 0")), _writes(s, d)),
    """
SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 7 = 0) GROUP BY 1""",
)
add(
    "str_mset",
    lambda s, d: st.mset(b.parts(s, d), _pairs(s, d)),
    f"SELECT key, value FROM {PAIRS} AS n UNION ALL SELECT key, value FROM {b.PARTS} AS p WHERE key NOT IN (SELECT key FROM {PAIRS} AS n)",
)
add(
    "str_msetnx",
    lambda s, d: st.msetnx(b.parts(s, d), _pairs(s, d)),
    f"SELECT txn, bool_and(key NOT IN (SELECT key FROM {b.PARTS} AS p)) AS done FROM {PAIRS} AS n GROUP BY txn",
)
add(
    "str_setex",
    lambda s, d: st.set_with_expiry(_writes(s, d), now()).select("key", "value", F.unix_millis("expire_at").alias("due_ms")),
    f"""
SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value, arg_max({b.NOW_MS} + floor(value)::BIGINT * 1000, (ts, event_id)) AS due_ms FROM events WHERE floor(value) > 0 GROUP BY 1""",
)
add(
    "str_getset",
    lambda s, d: st.get_set(_writes(s, d)).select("event_id", "old_value"),
    "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events",
)
add(
    "str_getdel",
    lambda s, d: st.get_delete(b.parts(s, d), _requested(s, d))[1],
    "SELECT 'part:' || p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 2 = 0",
)


def _expiring_parts(s, d):
    return b.parts(s, d).withColumn("due_ms", F.when(F.length("value") % 3 == 0, F.lit(b.NOW_MS) + 5000).cast("long"))


def _reads(s, d):
    """A GETEX of every part, of each mode in turn, some with amounts that are refused."""
    k = F.col("p_partkey")
    mode = F.element_at(F.array(F.lit("EX"), F.lit("PX"), F.lit("PERSIST"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    return load(s, d, "part").select(F.concat(F.lit("part:"), k.cast("string")).alias("key"), mode.alias("mode"), (k % 9 - 1).alias("amount"))


GETEX = f"""(SELECT 'part:' || p_partkey AS key, p_name AS value, ['EX', 'PX', 'PERSIST', NULL][p_partkey % 4 + 1] AS mode, p_partkey % 9 - 1 AS amount,
  CASE WHEN length(p_name) % 3 = 0 THEN {b.NOW_MS} + 5000 END AS due_ms, p_partkey % 4 > 1 OR p_partkey % 9 > 1 AS ok FROM part)"""
add(
    "str_getex",
    lambda s, d: st.get_ex(_expiring_parts(s, d), _reads(s, d), F.lit(b.NOW_MS))[0],
    f"SELECT key, mode, ok, CASE WHEN ok THEN value END AS value FROM {GETEX} AS g",
)
add(
    "str_getex_left",
    lambda s, d: st.get_ex(_expiring_parts(s, d), _reads(s, d), F.lit(b.NOW_MS))[1],
    f"""
SELECT key, value, CASE WHEN NOT ok OR mode IS NULL THEN due_ms WHEN mode = 'EX' THEN {b.NOW_MS} + amount * 1000 WHEN mode = 'PX' THEN {b.NOW_MS} + amount END AS due_ms FROM {GETEX} AS g""",
)


def _options(s, d):
    """SET of every event with the options its number gives; half of the users exist before."""
    e, k = load(s, d, "events"), F.col("event_id")
    cond = F.when(k % 5 == 0, "NX").when(k % 3 == 0, "XX")
    due = F.when(k % 4 == 0, F.lit(b.NOW_MS) + k)
    writes = e.select(F.col("user_id").alias("key"), "event_id", F.concat("event_type", k.cast("string")).alias("value"), F.struct("ts", "event_id").alias("seq"), cond.alias("cond"), (k % 7 == 0).alias("keep_ttl"), due.cast("long").alias("due_ms"))
    kv = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("key")).agg(F.lit("before").alias("value"), F.lit(1).cast("long").alias("due_ms"))
    return kv, writes


OPTIONS = f"""(SELECT *, CASE cond WHEN 'NX' THEN NOT x WHEN 'XX' THEN x ELSE true END AS done FROM
  (SELECT *, user_id % 2 = 0 OR coalesce(bool_or(cond IS DISTINCT FROM 'XX') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS x FROM
    (SELECT user_id, ts, event_id, event_type || event_id AS v, CASE WHEN event_id % 5 = 0 THEN 'NX' WHEN event_id % 3 = 0 THEN 'XX' END AS cond, event_id % 7 = 0 AS keep, CASE WHEN event_id % 4 = 0 THEN {b.NOW_MS} + event_id END AS due FROM events)))"""
add(
    "str_set_options",
    lambda s, d: st.set_replies(*_options(s, d)).select("event_id", "done", "old_value"),
    f"""
SELECT event_id, done, coalesce(last_value(CASE WHEN done THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN user_id % 2 = 0 THEN 'before' END) AS old_value FROM {OPTIONS} AS o""",
)
add(
    "str_set_left",
    lambda s, d: st.set_state(_options(s, d)[0], st.set_replies(*_options(s, d))),
    f"""
WITH o AS (SELECT * FROM {OPTIONS} AS o WHERE done), u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0 UNION SELECT user_id FROM o),
n AS (SELECT user_id, arg_max(v, (ts, event_id)) AS v FROM o GROUP BY 1), t AS (SELECT user_id, arg_max(struct_pack(d := due), (ts, event_id)) AS t FROM o WHERE NOT keep OR due IS NOT NULL GROUP BY 1)
SELECT u.user_id AS key, coalesce(n.v, 'before') AS value, CASE WHEN t.user_id IS NOT NULL THEN t.t.d WHEN u.user_id % 2 = 0 THEN 1 END AS due_ms FROM u LEFT JOIN n USING (user_id) LEFT JOIN t USING (user_id)""",
)

add(
    "str_append",
    lambda s, d: b.parts(s, d).withColumn("value", st.append(F.col("value"), F.lit("é!"))).select("key", "value", st.strlen(F.col("value")).alias("n_bytes")),
    f"SELECT key, value || 'é!' AS value, strlen(value || 'é!') AS n_bytes FROM {b.PARTS} AS p",
)
add(
    "str_append_fold",
    lambda s, d: st.append_all(load(s, d, "events").select(F.col("user_id").alias("key"), F.substring("event_type", 1, 1).alias("value"), F.struct("ts", "event_id").alias("seq"))),
    "SELECT user_id AS key, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS value FROM events GROUP BY 1",
)
add(
    "str_strlen",
    lambda s, d: _docs(s, d).select("doc_id", st.strlen(F.col("text")).alias("n_bytes")),
    "SELECT doc_id, strlen(text) AS n_bytes FROM documents",
)
add(
    "str_getrange",
    lambda s, d: _docs(s, d).select("doc_id", st.getrange(F.col("text"), 5, 24).alias("a"), st.getrange(F.col("text"), -10, -1).alias("b"), st.getrange(F.col("text"), 9, 3).alias("c")),
    "SELECT doc_id, substr(text, 6, 20) AS a, right(text, 10) AS b, '' AS c FROM documents",
)
add(
    "str_setrange",
    lambda s, d: b.parts(s, d).select("key", st.setrange(F.col("value"), 6, F.lit("redo")).alias("value")),
    f"SELECT key, CASE WHEN length(value) >= 6 THEN substr(value, 1, 6) || 'redo' || substr(value, 11) ELSE value || repeat(chr(0), 6 - length(value)::INT) || 'redo' END AS value FROM {b.PARTS} AS p",
)
add(
    "str_incrby",
    lambda s, d: load(s, d, "part").select("p_partkey", st.incr(F.col("p_size").cast("string"), 5).alias("n"), st.incr(F.col("p_brand"), 1).alias("bad")),
    "SELECT p_partkey, p_size::BIGINT + 5 AS n, NULL::BIGINT AS bad FROM part",
)
add(
    "str_decrby",
    lambda s, d: load(s, d, "part").select("p_partkey", st.incr(F.col("p_size").cast("string"), -3).alias("n")),
    "SELECT p_partkey, p_size::BIGINT - 3 AS n FROM part",
)
add(
    "str_incrbyfloat",
    lambda s, d: load(s, d, "events").select("event_id", F.round(st.incr_float(F.col("value").cast("string"), F.lit(0.5)), 6).alias("x")),
    "SELECT event_id, round(value + 0.5::DOUBLE, 6) AS x FROM events",
)

add("log_incr_segments", lambda s, d: st.counters(b.log(s, d).where("op <> 'APPEND'")).select("event_id", "key", "counter"), f"""
WITH l AS (SELECT * FROM {b.LOG} AS l WHERE op <> 'APPEND'),
g AS (SELECT *, sum(CASE WHEN op IN ('SET', 'DEL') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS g FROM l)
SELECT event_id, key, sum(CASE WHEN op = 'DEL' THEN 0 ELSE n END) OVER (PARTITION BY key, g ORDER BY seq)::BIGINT AS counter FROM g""")
add("log_incr_final", lambda s, d: st.counters_now(b.log(s, d)), f"""
WITH l AS (SELECT * FROM {b.LOG} AS l WHERE op <> 'APPEND'),
g AS (SELECT *, sum(CASE WHEN op IN ('SET', 'DEL') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS g FROM l),
r AS (SELECT *, sum(CASE WHEN op = 'DEL' THEN 0 ELSE n END) OVER (PARTITION BY key, g ORDER BY seq) AS c FROM g)
SELECT key, arg_max(c, seq)::BIGINT AS counter FROM r GROUP BY key""")


def _flushes(s, d):
    """The log with every 500th event as a FLUSHDB of its database."""
    cmd = F.when(F.col("event_id") % 500 == 0, "FLUSHDB").when(F.col("op") == "DEL", "DEL").otherwise("SET")
    return b.log(s, d).select("seq", "db", "key", cmd.alias("cmd"), F.col("event_type").alias("arg"))


add("log_flush_barrier", lambda s, d: cl.strings(_flushes(s, d)), f"""
WITH l AS (SELECT *, CASE WHEN event_id % 500 = 0 THEN 'FLUSHDB' WHEN op = 'DEL' THEN 'DEL' ELSE 'SET' END AS cmd FROM {b.LOG} AS l),
f AS (SELECT db, max(seq) AS s FROM l WHERE cmd = 'FLUSHDB' GROUP BY db),
k AS (SELECT db, key, max(seq) AS s FROM l WHERE cmd = 'DEL' GROUP BY db, key)
SELECT l.db, l.key, arg_max(event_type, seq) AS value FROM l LEFT JOIN f ON l.db = f.db LEFT JOIN k ON l.db = k.db AND l.key = k.key
WHERE cmd = 'SET' AND (f.s IS NULL OR seq > f.s) AND (k.s IS NULL OR seq > k.s) GROUP BY l.db, l.key""")


def _expiring(s, d):
    cmd = F.when(F.col("event_type") == "purchase", "EXPIRE").otherwise("SET")
    e = b.events(s, d)
    return e.select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").alias("key"), cmd.alias("cmd"), F.when(cmd == "EXPIRE", (F.floor("value") * 3600000).cast("string")).otherwise(F.col("event_id").cast("string")).alias("arg"), F.timestamp_millis("ms").alias("ts"))


add(
    "ttl_log_fold",
    lambda s, d: cl.expiring(_expiring(s, d), F.timestamp_millis(F.lit(1706400000000))),
    """
WITH s AS (SELECT user_id AS key, arg_max(event_id, (ts, event_id))::VARCHAR AS value, max((ts, event_id)) AS q FROM events WHERE event_type <> 'purchase' GROUP BY 1),
x AS (SELECT user_id AS key, arg_max((epoch_us(ts) // 1000) + floor(events.value)::BIGINT * 3600000, (ts, event_id)) AS due FROM events JOIN s ON user_id = key WHERE event_type = 'purchase' AND (ts, event_id) > q GROUP BY 1)
SELECT s.key, value FROM s LEFT JOIN x ON s.key = x.key WHERE due IS NULL OR due > 1706400000000""",
)
