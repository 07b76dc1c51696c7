"""Hashes as ``(key, field, value)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hset(writes: DataFrame) -> DataFrame:
    """``writes(key, field, value, seq)``: the last value of each field."""
    return writes.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def hset_new_fields(writes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``key, added``: how many fields are new, what HSET returns."""
    new = writes.select("key", "field").distinct()
    if before is not None:
        new = new.join(before.select("key", "field"), ["key", "field"], "left_anti")
    return new.groupBy("key").agg(F.count("*").alias("added"))


def hget(h: DataFrame, field) -> DataFrame:
    return h.where(F.col("field") == field).select("key", "value")


def hmget(h: DataFrame, fields: list) -> DataFrame:
    """``key, pos, field, value`` for every key and requested field, null where missing."""
    picked = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{i}") for i, f in enumerate(fields)]
    wide = h.groupBy("key").agg(*picked)
    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(f"_{i}").alias("value")) for i, f in enumerate(fields)))
    return wide.select("key", F.inline(rows))


def hgetall(h: DataFrame) -> DataFrame:
    """``key, fields``: each hash as a map."""
    return h.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hdel(h: DataFrame, dropped: DataFrame) -> DataFrame:
    """Without the fields ``dropped(key, field)``, or ``dropped(field)`` for every key."""
    return h.join(dropped.distinct(), [c for c in ("key", "field") if c in dropped.columns], "left_anti")


def hexists(h: DataFrame, field) -> DataFrame:
    return h.groupBy("key").agg(F.bool_or(F.col("field") == field).cast("int").alias("present"))


def hlen(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count("*").alias("n_fields"))


def hkeys(h: DataFrame) -> DataFrame:
    return h.select("key", "field")


def hvals(h: DataFrame) -> DataFrame:
    return h.select("key", "value")


def hstrlen(h: DataFrame, field) -> DataFrame:
    return h.where(F.col("field") == field).select("key", F.octet_length(F.col("value").cast("string")).cast("long").alias("n_bytes"))


def hincrby(log: DataFrame) -> DataFrame:
    """``log(key, field, n)``: the sum of each field's increments."""
    return log.groupBy("key", "field").agg(F.sum("n").alias("value"))
