"""Queries of lists, hashes and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import hashes as h
from quern.operators import lists as ls
from quern.operators import sets as ss
from quern.plans import bind as b
from quern.plans.registry import add
from quern.sources.tables import load


def _pushes(s, d, side=None):
    side = F.lit(side) if side else F.when(F.col("event_type") == "error", "L").otherwise("R")
    return load(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), side.alias("side"), F.col("event_id").alias("value"))


def _typed(s, d):
    """Lists of event types, for removal by value."""
    return b.lists(s, d).join(load(s, d, "events").select(F.col("event_id").alias("value"), "event_type"), "value").select("key", "pos", F.col("event_type").alias("value"))


TYPED = "(SELECT l.key, l.pos, e.event_type AS value FROM " + b.LISTS + " AS l JOIN events AS e ON e.event_id = l.value)"
LEN = f"(SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {b.LISTS} AS l)"

add(
    "list_lpush",
    lambda s, d: ls.from_pushes(_pushes(s, d, "L")),
    "SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS pos, event_id AS value FROM events",
)
add(
    "list_rpush",
    lambda s, d: ls.from_pushes(_pushes(s, d, "R")),
    "SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_id AS value FROM events",
)
add(
    "list_push_both",
    lambda s, d: ls.from_pushes(_pushes(s, d)),
    "SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, CASE WHEN event_type = 'error' THEN -event_id ELSE event_id END) - 1 AS pos, event_id AS value FROM events",
)
add("list_llen", lambda s, d: ls.llen(b.lists(s, d)), "SELECT user_id AS key, count(*) AS length FROM events GROUP BY 1")
add("list_lrange", lambda s, d: ls.lrange(b.lists(s, d), -3, -1), f"SELECT key, pos, value FROM {LEN} AS l WHERE pos >= n - 3")
add("list_lindex", lambda s, d: ls.lindex(b.lists(s, d), 5), f"SELECT key, value FROM {b.LISTS} AS l WHERE pos = 5")
add(
    "list_lset",
    lambda s, d: ls.lset(b.lists(s, d), -2, F.lit(0).cast("long")),
    f"SELECT key, pos, CASE WHEN pos = n - 2 THEN 0 ELSE value END AS value FROM {LEN} AS l",
)
add("list_ltrim", lambda s, d: ls.ltrim(b.lists(s, d), 2, -4), f"SELECT key, pos - 2 AS pos, value FROM {LEN} AS l WHERE pos >= 2 AND pos <= n - 4")
add("list_lrem", lambda s, d: ls.lrem(_typed(s, d), -2, F.lit("click")), f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY key, value = 'click' ORDER BY pos DESC) AS r FROM {TYPED} AS l)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM r WHERE value <> 'click' OR r > 2""")
add(
    "list_lrem_all",
    lambda s, d: ls.lrem(_typed(s, d), 0, F.lit("view")),
    f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM {TYPED} AS l WHERE value <> 'view'",
)
add("list_lpop", lambda s, d: ls.lpop(b.lists(s, d)), "SELECT user_id AS key, arg_min(event_id, (ts, event_id)) AS value FROM events GROUP BY 1")
add("list_rpop", lambda s, d: ls.rpop(b.lists(s, d)), "SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS value FROM events GROUP BY 1")
add("list_after_lpop", lambda s, d: ls.after_lpop(b.lists(s, d)), f"SELECT key, pos - 1 AS pos, value FROM {b.LISTS} AS l WHERE pos > 0")
add("list_after_rpop", lambda s, d: ls.after_rpop(b.lists(s, d)), f"SELECT key, pos, value FROM {LEN} AS l WHERE pos < n - 1")
_MOVE = """
WITH l AS (SELECT * FROM {lists} AS l WHERE key IN (3, 4)), m AS (SELECT * FROM l WHERE key = 3 AND pos = (SELECT {edge}(pos) FROM l WHERE key = 3)),
u AS (SELECT * FROM l WHERE NOT (key = 3 AND pos = (SELECT pos FROM m)) UNION ALL SELECT 4, {to}, value FROM m)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM u"""
add("list_rpoplpush", lambda s, d: ls.lmove(b.lists(s, d), 3, 4), _MOVE.format(lists=b.LISTS, edge="max", to="-1"))
add("list_lmove", lambda s, d: ls.lmove(b.lists(s, d), 3, 4, "LEFT", "RIGHT"), _MOVE.format(lists=b.LISTS, edge="min", to="1000000000"))


def _clients(s, d):
    c = load(s, d, "customer").where("c_custkey % 50 = 0")
    return c.select(F.col("c_custkey").alias("client"), F.posexplode(F.array(F.col("c_custkey") + 1_000_000, F.col("c_custkey") % 150, F.lit(5).cast("long")))).select("client", F.col("pos").alias("key_pos"), F.col("col").alias("key"))


add(
    "list_blpop_pick",
    lambda s, d: ls.blocking_pick(b.lists(s, d), _clients(s, d)),
    f"""
WITH r AS (SELECT c_custkey AS client, unnest([c_custkey + 1000000, c_custkey % 150, 5]) AS key, unnest([0, 1, 2]) AS p FROM customer WHERE c_custkey % 50 = 0),
e AS (SELECT r.*, l.value FROM r JOIN {b.LISTS} AS l ON r.key = l.key AND pos = 0),
x AS (SELECT client, arg_min(key, p) AS key, arg_min(value, p) AS value FROM e GROUP BY client)
SELECT DISTINCT r.client, x.key, x.value FROM r LEFT JOIN x USING (client)""",
)

def _waits(s, d):
    """Views wait at their user's list, other events push to it."""
    op = F.when(F.col("event_type") == "view", "WAIT").otherwise("PUSH")
    return load(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").cast("string").alias("arg"))


add(
    "list_blocking_pops",
    lambda s, d: ls.blocking_pops(_waits(s, d)),
    """
WITH n AS (SELECT user_id AS key, event_id AS e, event_type = 'view' AS w, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY event_id) AS n FROM events)
SELECT w.e::VARCHAR AS client, w.key, p.e::VARCHAR AS value, greatest(w.e, p.e) AS at FROM n AS w JOIN n AS p ON w.key = p.key AND w.n = p.n AND w.w AND NOT p.w""",
)
add("hash_hset", lambda s, d: b.hashes(s, d), f"SELECT key, field, value FROM {b.HASHES} AS h")
add(
    "hash_hset_added",
    lambda s, d: h.hset_new_fields(b.hash_writes(s, d)),
    "SELECT user_id AS key, count(DISTINCT event_type) AS added FROM events GROUP BY 1",
)
add("hash_hget", lambda s, d: h.hget(b.hashes(s, d), "click"), f"SELECT key, value FROM {b.HASHES} AS h WHERE field = 'click'")
add("hash_hmget", lambda s, d: h.hmget(b.hashes(s, d), ["view", "none", "click"]), f"""
WITH f AS (SELECT unnest(['view', 'none', 'click']) AS field, unnest([0, 1, 2]) AS pos), k AS (SELECT DISTINCT key FROM {b.HASHES} AS h)
SELECT k.key, f.pos, f.field, h.value FROM k CROSS JOIN f LEFT JOIN {b.HASHES} AS h ON h.key = k.key AND h.field = f.field""")
add(
    "hash_hgetall",
    lambda s, d: h.hgetall(b.hashes(s, d)).select("key", F.size("fields").cast("long").alias("n"), F.explode("fields").alias("field", "value")),
    f"SELECT key, count(*) OVER (PARTITION BY key) AS n, field, value FROM {b.HASHES} AS h",
)
add(
    "hash_hdel",
    lambda s, d: h.hdel(b.hashes(s, d), b.hashes(s, d).where("value < 50").select("key", "field")),
    f"SELECT key, field, value FROM {b.HASHES} AS h WHERE value >= 50",
)
add(
    "hash_hexists",
    lambda s, d: h.hexists(b.hashes(s, d), "purchase"),
    "SELECT user_id AS key, bool_or(event_type = 'purchase')::INT AS present FROM events GROUP BY 1",
)
add("hash_hlen", lambda s, d: h.hlen(b.hashes(s, d)), "SELECT user_id AS key, count(DISTINCT event_type) AS n_fields FROM events GROUP BY 1")
add("hash_hkeys", lambda s, d: h.hkeys(b.hashes(s, d)), "SELECT DISTINCT user_id AS key, event_type AS field FROM events")
add("hash_hvals", lambda s, d: h.hvals(b.hashes(s, d)), f"SELECT key, value FROM {b.HASHES} AS h")
add(
    "hash_hstrlen",
    lambda s, d: h.hstrlen(load(s, d, "documents").select(F.col("doc_id").alias("key"), F.lit("text").alias("field"), F.col("text").alias("value")), "text"),
    "SELECT doc_id AS key, strlen(text) AS n_bytes FROM documents",
)

IN = [f"(SELECT member FROM {b.SETS} AS t WHERE key = {k})" for k in range(4)]
add(
    "set_sadd",
    lambda s, d: ss.sadd(load(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member"))),
    f"SELECT key, member FROM {b.SETS} AS t",
)
add(
    "set_srem",
    lambda s, d: ss.srem(b.sets(s, d), b.sets(s, d).where("member % 3 = 0")),
    f"SELECT key, member FROM {b.SETS} AS t WHERE member % 3 <> 0",
)
add(
    "set_sismember",
    lambda s, d: ss.sismember(b.sets(s, d), load(s, d, "part").select(F.lit(1).cast("long").alias("key"), F.col("p_partkey").alias("member"))),
    "SELECT 1::BIGINT AS key, p_partkey AS member, (p_partkey IN " + IN[1] + ")::INT AS present FROM part",
)
add("set_smembers", lambda s, d: ss.smembers(b.sets(s, d), 7), f"SELECT member FROM {b.SETS} AS t WHERE key = 7")
add("set_scard", lambda s, d: ss.scard(b.sets(s, d)), "SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS n_members FROM lineitem GROUP BY 1")
add("set_sinter", lambda s, d: ss.sinter(b.sets(s, d), [1, 2, 3]), f"{IN[1]} INTERSECT {IN[2]} INTERSECT {IN[3]}")
add("set_sunion", lambda s, d: ss.sunion(b.sets(s, d), [1, 2, 3]), f"{IN[1]} UNION {IN[2]} UNION {IN[3]}")
add("set_sdiff", lambda s, d: ss.sdiff(b.sets(s, d), 1, [2, 3]), f"{IN[1]} EXCEPT {IN[2]} EXCEPT {IN[3]}")


def _stored(s, d):
    """Set -1 is what sets 1 and 2 have in common, -2 all of them, -3 what 1 has and 2 hasn't."""
    every, out = b.sets(s, d), b.sets(s, d)
    for dest, members in ((-1, ss.sinter(every, [1, 2])), (-2, ss.sunion(every, [1, 2])), (-3, ss.sdiff(every, 1, [2]))):
        out = ss.store(out, dest, members)
    return out


add(
    "set_sstore",
    _stored,
    f"""
SELECT key, member FROM {b.SETS} AS t UNION ALL SELECT -1, member FROM ({IN[1]} INTERSECT {IN[2]})
UNION ALL SELECT -2, member FROM ({IN[1]} UNION {IN[2]}) UNION ALL SELECT -3, member FROM ({IN[1]} EXCEPT {IN[2]})""",
)
add(
    "set_smove",
    lambda s, d: ss.smove(b.sets(s, d), b.sets(s, d).where("key = 1").select(F.lit(1).cast("long").alias("src"), F.lit(2).cast("long").alias("dst"), "member")).where("key IN (1, 2)"),
    f"SELECT 2::BIGINT AS key, member FROM ({IN[1]} UNION {IN[2]})",
)
add(
    "set_spop",
    lambda s, d: ss.scard(ss.spop(b.sets(s, d), 3)[0]),
    "SELECT key, least(n, 3)::BIGINT AS n_members FROM (SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)",
)
add(
    "set_srandmember",
    lambda s, d: ss.srandmember(b.sets(s, d), -5).groupBy("key").agg(F.count("*").alias("n_drawn")),
    "SELECT DISTINCT l_suppkey AS key, 5::BIGINT AS n_drawn FROM lineitem",
)
