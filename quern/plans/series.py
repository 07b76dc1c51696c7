"""Queries of time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import timeseries as ts
from quern.plans import bind as b
from quern.plans.registry import add

HOUR, DAY, START, END = 3_600_000, 86_400_000, 1704067203000, 1705000000000
RETENTION = 2 * DAY


def _shuffled(s, d):
    """Samples that arrive out of order: within each series by the remainder of the event's number."""
    return b.series(s, d).withColumn("seq", F.struct((F.col("seq") * 7919 % 101).alias("a"), F.col("seq").alias("b")))


SHUFFLED = f"(SELECT key, ts, value, seq AS e, (seq * 7919 % 101, seq) AS seq FROM {b.SERIES} AS t)"
add(
    "ts_add_late_reject",
    lambda s, d: ts.accept(_shuffled(s, d)).select("key", "ts", F.col("seq.b").alias("event_id")),
    f"SELECT key, ts, e AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM {SHUFFLED} AS s) WHERE ts >= top",
)
add(
    "ts_add_overwrite",
    lambda s, d: ts.overwrite(b.series(s, d).withColumn("ts", F.floor(F.col("ts") / HOUR) * HOUR)),
    f"SELECT key, ts // {HOUR} * {HOUR} AS ts, arg_max(value, seq) AS value FROM {b.SERIES} AS t GROUP BY ALL",
)
add(
    "ts_add",
    lambda s, d: ts.add(_shuffled(s, d), RETENTION),
    f"""
WITH a AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM {SHUFFLED} AS s) WHERE ts >= top),
o AS (SELECT key, ts, arg_max(value, seq) AS value FROM a GROUP BY ALL)
SELECT key, ts, value FROM o QUALIFY ts >= max(ts) OVER (PARTITION BY key) - {RETENTION}""",
)
add(
    "ts_retention",
    lambda s, d: ts.retain(b.series(s, d), RETENTION).select("key", "ts", "value"),
    f"SELECT key, ts, value FROM {b.SERIES} AS t QUALIFY ts >= max(ts) OVER (PARTITION BY key) - {RETENTION}",
)
add(
    "ts_get",
    lambda s, d: ts.last(ts.overwrite(b.series(s, d))),
    f"SELECT key, max(ts) AS ts, arg_max(value, (ts, seq)) AS value FROM {b.SERIES} AS t GROUP BY key",
)
add(
    "ts_range_raw",
    lambda s, d: ts.between(b.series(s, d), START, END).select("key", "ts", "value"),
    f"SELECT key, ts, value FROM {b.SERIES} AS t WHERE ts BETWEEN {START} AND {END}",
)
for agg in ("avg", "sum", "min", "max"):
    add(f"ts_range_{agg}", lambda s, d, a=agg: ts.buckets(b.series(s, d), START, END, a, HOUR).withColumn("value", F.round("value", 6)), f"""
SELECT key, (ts - {START}) // {HOUR} * {HOUR} + {START} AS bucket, round({agg}(value), 6) AS value FROM {b.SERIES} AS t WHERE ts BETWEEN {START} AND {END} GROUP BY ALL""")
add(
    "ts_rule_epoch",
    lambda s, d: ts.rule(b.series(s, d), "sum", DAY).withColumn("value", F.round("value", 4)),
    f"SELECT key, ts // {DAY} * {DAY} AS bucket, round(sum(value), 4) AS value FROM {b.SERIES} AS t GROUP BY ALL",
)
RULES = [("click", "click:max", "max", DAY), ("click", "click:avg", "avg", HOUR), ("view", "view:min", "min", HOUR)]
add(
    "ts_rules",
    lambda s, d: ts.rules(b.series(s, d), s.createDataFrame(RULES, "src string, dst string, agg string, bucket_ms long")).withColumn("value", F.round("value", 6)),
    " UNION ALL ".join(
    f"SELECT '{dst}' AS key, ts // {ms} * {ms} AS bucket, round({agg}(value), 6) AS value FROM {b.SERIES} AS t WHERE key = '{src}' GROUP BY ALL" for src, dst, agg, ms in RULES),
)


def _created(s, d):
    """A series for each event type, created again by each user, some without saying how long it keeps."""
    e = b.events(s, d)
    return e.select(F.col("event_type").alias("key"), F.when(F.col("user_id") % 3 == 0, F.col("user_id") * HOUR).alias("retention_ms"), F.struct("ts", "event_id").alias("seq"))


CREATED = f"(SELECT event_type AS key, coalesce(arg_max(user_id * {HOUR}, (ts, event_id)) FILTER (user_id % 3 = 0), 0) AS retention_ms FROM events GROUP BY 1)"


def _none(s):
    return s.createDataFrame([], "key string, retention_ms long")


add("ts_create", lambda s, d: ts.create(_none(s), _created(s, d)), f"SELECT key, retention_ms FROM {CREATED} AS c")
add(
    "ts_retention_each",
    lambda s, d: ts.retain_each(b.series(s, d), ts.create(_none(s), _created(s, d))).select("key", "ts", "value"),
    f"""
SELECT t.key, t.ts, t.value FROM (SELECT *, max(ts) OVER (PARTITION BY key) AS top FROM {b.SERIES} AS t) AS t JOIN {CREATED} AS c ON t.key = c.key WHERE c.retention_ms = 0 OR t.ts >= top - c.retention_ms""",
)
