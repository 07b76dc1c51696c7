"""Queries of streams and consumer groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import streams as st
from quern.plans import bind as b
from quern.plans.registry import add

A, Z, LAST = "1704500000000-0", "1705500000000-0", "1706000000000-0"


def _after(s, d, last=LAST):
    return s.createDataFrame([("click", last), ("view", last)], "key string, last_id string")


def _pending(s, d):
    """Groups that begin before the first entry of every channel."""
    groups = b.stream(s, d).select("key").distinct().select("key", F.lit("0").alias("last_id"), F.lit("g").alias("grp"))
    return st.deliver(b.stream(s, d), groups, 3)


PENDING = f"""(SELECT key, 'g' AS grp, id, arrival, 'c' || ((row_number() OVER (PARTITION BY key ORDER BY arrival) - 1) % 3) AS consumer
  FROM {b.STREAM} AS s WHERE id > '0')"""


def _acks(s, d):
    return _pending(s, d).where("arrival % 3 = 0").select("key", "grp", "id")


add("stream_xadd_ids", lambda s, d: b.stream(s, d).select("key", "arrival", "id"), f"SELECT key, arrival, id FROM {b.STREAM} AS s")
add(
    "stream_xrange",
    lambda s, d: st.xrange(b.stream(s, d), A, Z).select("key", "id"),
    f"SELECT key, id FROM {b.STREAM} AS s WHERE id BETWEEN '{A}' AND '{Z}'",
)
add("stream_xlen", lambda s, d: st.xlen(b.stream(s, d)), "SELECT event_type AS key, count(*) AS length FROM events GROUP BY 1")
add(
    "stream_xread",
    lambda s, d: st.xread(b.stream(s, d), _after(s, d), 20).select("key", "id"),
    f"SELECT key, id FROM {b.STREAM} AS s WHERE key IN ('click', 'view') AND id > '{LAST}' QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival) <= 20",
)
add(
    "stream_xgroup_create",
    lambda s, d: st.xgroup_create(b.stream(s, d), "g"),
    f"SELECT key, 'g' AS grp, arg_max(id, arrival) AS last_id FROM {b.STREAM} AS s GROUP BY key",
)
add("stream_xreadgroup", _pending, f"SELECT key, grp, id, arrival, consumer FROM {PENDING} AS p")
add(
    "stream_group_positions",
    lambda s, d: st.group_positions(_pending(s, d)),
    f"SELECT key, grp, arg_max(id, arrival) AS last_id FROM {PENDING} AS p GROUP BY ALL",
)
add(
    "stream_xack",
    lambda s, d: st.xack(_pending(s, d), _acks(s, d)),
    f"SELECT key, grp, id, arrival, consumer FROM {PENDING} AS p WHERE arrival % 3 <> 0",
)
add(
    "stream_xpending",
    lambda s, d: st.xpending(_pending(s, d)),
    f"SELECT key, grp, count(*) AS n_pending, min(id) AS min_id, max(id) AS max_id, string_agg(DISTINCT consumer, ',' ORDER BY consumer) AS consumers FROM {PENDING} AS p GROUP BY ALL",
)
add(
    "stream_xclaim",
    lambda s, d: st.xclaim(_pending(s, d), _acks(s, d).withColumn("new_consumer", F.lit("c9"))),
    f"SELECT key, grp, id, arrival, CASE WHEN arrival % 3 = 0 THEN 'c9' ELSE consumer END AS consumer FROM {PENDING} AS p",
)
add(
    "stream_xdel",
    lambda s, d: st.xdel(b.stream(s, d), b.stream(s, d).where("user_id % 2 = 0")).select("key", "id"),
    f"SELECT key, id FROM {b.STREAM} AS s WHERE user_id % 2 <> 0",
)
add(
    "stream_xtrim",
    lambda s, d: st.xtrim(b.stream(s, d), 50).select("key", "id"),
    f"SELECT key, id FROM {b.STREAM} AS s QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC) <= 50",
)
add(
    "stream_xinfo_stream",
    lambda s, d: st.xinfo_stream(b.stream(s, d)),
    f"SELECT key, count(*) AS length, arg_max(id, arrival) AS last_generated_id FROM {b.STREAM} AS s GROUP BY key",
)
add(
    "stream_xinfo_groups",
    lambda s, d: st.xinfo_groups(_pending(s, d)),
    f"SELECT key, grp, count(DISTINCT consumer) AS consumers, count(*) AS pending, arg_max(id, arrival) AS last_delivered_id FROM {PENDING} AS p GROUP BY ALL",
)
