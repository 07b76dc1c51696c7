"""Append-only streams as ``(key, arrival, id, ...)`` rows, with groups and pending entries.

Ids are compared as text, as stored streams were; ``numeric_id`` gives the
order of their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auto_ids(entries: DataFrame) -> DataFrame:
    """``entries(key, ms, arrival)`` with ``id``: the millisecond and a number within it."""
    n = F.row_number().over(Window.partitionBy("key", "ms").orderBy("arrival")) - 1
    return entries.withColumn("id", F.concat_ws("-", F.col("ms").cast("string"), n.cast("string")))


def numeric_id(id_: Column) -> Column:
    return F.struct(F.split(id_, "-")[0].cast("long").alias("ms"), F.coalesce(F.split(id_, "-")[1].cast("long"), F.lit(0)).alias("n"))


def xrange(stream: DataFrame, start: str = "-", end: str = "+") -> DataFrame:
    out = stream if start == "-" else stream.where(F.col("id") >= start)
    return out if end == "+" else out.where(F.col("id") <= end)


def xlen(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count("*").alias("length"))


def xread(stream: DataFrame, after: DataFrame, count: int | None = None) -> DataFrame:
    """Entries after ``after(key, last_id)``, at most ``count`` a key, in order of arrival."""
    new = stream.join(after, "key").where("id > last_id").drop("last_id")
    if count is None:
        return new
    n = F.row_number().over(Window.partitionBy("key").orderBy("arrival"))
    return new.withColumn("_n", n).where(F.col("_n") <= count).drop("_n")


def deliver(stream: DataFrame, groups: DataFrame, consumers: int) -> DataFrame:
    """Pending entries ``key, grp, id, arrival, consumer`` after the consumers have read in turn.

    ``groups(key, grp, last_id)``: only entries after ``last_id`` are delivered.
    """
    new = stream.join(groups, "key").where("id > last_id")
    n = F.row_number().over(Window.partitionBy("key", "grp").orderBy("arrival")) - 1
    return new.select("key", "grp", "id", "arrival", F.concat(F.lit("c"), (n % consumers).cast("string")).alias("consumer"))


def xgroup_create(stream: DataFrame, grp: str, start: str = "$") -> DataFrame:
    """``key, grp, last_id``: a new group at the end, or at an id."""
    last = F.max_by("id", "arrival") if start == "$" else F.lit(start)
    return stream.groupBy("key").agg(last.alias("last_id")).select("key", F.lit(grp).alias("grp"), "last_id")


def group_positions(pending: DataFrame) -> DataFrame:
    """``key, grp, last_id`` after delivery."""
    return pending.groupBy("key", "grp").agg(F.max_by("id", "arrival").alias("last_id"))


def xack(pending: DataFrame, acks: DataFrame) -> DataFrame:
    return pending.join(acks.select("key", "grp", "id").distinct(), ["key", "grp", "id"], "left_anti")


def xpending(pending: DataFrame) -> DataFrame:
    return pending.groupBy("key", "grp").agg(F.count("*").alias("n_pending"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.array_join(F.array_sort(F.collect_set("consumer")), ",").alias("consumers"))


def xclaim(pending: DataFrame, claims: DataFrame) -> DataFrame:
    """``claims(key, grp, id, new_consumer)`` take entries over."""
    out = pending.join(claims, ["key", "grp", "id"], "left")
    return out.select(*(F.coalesce("new_consumer", "consumer").alias("consumer") if c == "consumer" else c for c in pending.columns))


def xdel(stream: DataFrame, ids: DataFrame) -> DataFrame:
    return stream.join(ids.select("key", "id").distinct(), ["key", "id"], "left_anti")


def xtrim(stream: DataFrame, maxlen: int) -> DataFrame:
    """The newest ``maxlen`` entries of each key."""
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("arrival")))
    return stream.withColumn("_n", n).where(F.col("_n") <= maxlen).drop("_n")


def xinfo_stream(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count("*").alias("length"), F.max_by("id", "arrival").alias("last_generated_id"))


def xinfo_groups(pending: DataFrame) -> DataFrame:
    return pending.groupBy("key", "grp").agg(F.count_distinct("consumer").alias("consumers"), F.count("*").alias("pending"), F.max_by("id", "arrival").alias("last_delivered_id"))
