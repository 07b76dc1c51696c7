"""Sorted sets as ``(key, member, score)`` rows; order is score, then member, and is never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UP, DOWN = ("score", "member"), (F.desc, F.desc)


def _order(reverse: bool) -> list[Column]:
    way = F.desc if reverse else F.asc
    return [way("score"), way("member")]


def ranked(z: DataFrame, reverse: bool = False) -> DataFrame:
    """With ``rank`` from 0."""
    return z.withColumn("rank", (F.row_number().over(Window.partitionBy("key").orderBy(*_order(reverse))) - 1).cast("long"))


def zadd(writes: DataFrame) -> DataFrame:
    """``writes(key, member, score, seq)``: the last finite score of each member."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return writes.where(finite).groupBy("key", "member").agg(F.max_by("score", "seq").alias("score"))


def zrem(z: DataFrame, dropped: DataFrame) -> DataFrame:
    return z.join(dropped.select("key", "member").distinct(), ["key", "member"], "left_anti")


def zincrby(log: DataFrame) -> DataFrame:
    """``log(key, member, inc)``: scores by increments alone."""
    return log.groupBy("key", "member").agg(F.sum("inc").alias("score"))


def zscore(z: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(z, ["key", "member"], "left").select("key", "member", "score")


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("n_members"))


def zrank(z: DataFrame, reverse: bool = False) -> DataFrame:
    return ranked(z, reverse).select("key", "member", "rank")


def zrange(z: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """By place, both included, negative from the end. Places from the front need no count of the set."""
    if start < 0 or stop < 0:
        size = F.count("*").over(Window.partitionBy("key"))
        at = lambda i: F.lit(i) if i >= 0 else F.col("_len") + i
        out = ranked(z.withColumn("_len", size), reverse).where((F.col("rank") >= at(start)) & (F.col("rank") <= at(stop)))
        return out.select("key", "member", "score", "rank")
    return ranked(z, reverse).where(F.col("rank").between(start, stop)).select("key", "member", "score", "rank")


def zrangebyscore(z: DataFrame, low: float, high: float) -> DataFrame:
    """Scores within the bounds, both included; the filter reaches the scan."""
    return z.where(F.col("score").between(low, high)).select("key", "member", "score")


def zpop(z: DataFrame, count: int = 1, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members popped, and what is left; a count of 0 is 1."""
    n = ranked(z, largest)
    count = max(1, count)
    return n.where(F.col("rank") < count).select("key", "member"), n.where(F.col("rank") >= count).select("key", "member", "score")
