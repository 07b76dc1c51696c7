"""Lists as ``(key, pos, value)`` rows, or as arrays in a column.

Positions are dense and start at 0. Operators that touch the ends of a list
need only its length, so they use grouped counts and no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_pushes(log: DataFrame) -> DataFrame:
    """``log(key, seq, side, value)`` of LPUSH (side L) and RPUSH (side R) as a list."""
    rank = F.when(F.col("side") == "L", -F.col("seq")).otherwise(F.col("seq"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.when(F.col("side") == "L", 0).otherwise(1), rank)) - 1
    return log.select("key", place.cast("long").alias("pos"), "value")


def llen(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count("*").alias("length"))


def with_length(lists: DataFrame) -> DataFrame:
    return lists.withColumn("_len", F.count("*").over(Window.partitionBy("key")))


def _at(i: int) -> Column:
    return F.lit(i) if i >= 0 else F.col("_len") + i


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Inclusive; negative places count from the end."""
    src = lists if start >= 0 and stop >= 0 else with_length(lists)
    return src.where((F.col("pos") >= _at(start)) & (F.col("pos") <= _at(stop))).select("key", "pos", "value")


def lindex(lists: DataFrame, i: int) -> DataFrame:
    return lrange(lists, i, i).select("key", "value")


def lset(lists: DataFrame, i: int, value: Column) -> DataFrame:
    """Keys too short for the place are left as they are."""
    src = lists if i >= 0 else with_length(lists)
    return src.select("key", "pos", F.when(F.col("pos") == _at(i), value).otherwise(F.col("value")).alias("value"))


def _dense(lists: DataFrame) -> DataFrame:
    return lists.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1).cast("long").alias("pos"), "value")


def ltrim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    return _dense(lrange(lists, start, stop))


def lrem(lists: DataFrame, count: int, value: Column) -> DataFrame:
    """Without the first ``count`` elements equal to ``value``, from the tail where negative, all where 0."""
    hit = F.col("value") == value
    if count == 0:
        return _dense(lists.where(~hit))
    order = F.col("pos") if count > 0 else F.desc("pos")
    n = F.row_number().over(Window.partitionBy("key", F.when(hit, 1).otherwise(0)).orderBy(order))
    return _dense(lists.withColumn("_n", n).where(~hit | (F.col("_n") > abs(count))))


def lpop(lists: DataFrame) -> DataFrame:
    return lists.where("pos = 0").select("key", "value")


def rpop(lists: DataFrame) -> DataFrame:
    """An aggregate, so that no list is sorted for its tail."""
    return lists.groupBy("key").agg(F.max_by("value", "pos").alias("value"))


def after_lpop(lists: DataFrame) -> DataFrame:
    return lists.where("pos > 0").select("key", (F.col("pos") - 1).alias("pos"), "value")


def after_rpop(lists: DataFrame) -> DataFrame:
    return with_length(lists).where("pos < _len - 1").select("key", "pos", "value")


def lmove(lists: DataFrame, src, dst, from_side: str = "RIGHT", to_side: str = "LEFT") -> DataFrame:
    """Both lists after one element has moved; RPOPLPUSH is RIGHT to LEFT."""
    edge = (F.min if from_side == "LEFT" else F.max)("pos")
    own, ends = lists.where(F.col("key") == src), lists.where(F.col("key") == src).agg(edge.alias("_edge"))
    moved = own.join(F.broadcast(ends), F.col("pos") == F.col("_edge"), "left_semi")  # one row
    rest = lists.where(F.col("key").isin(src, dst)).join(moved.select("key", "pos"), ["key", "pos"], "left_anti")
    if to_side == "LEFT":
        put = moved.select(F.lit(dst).alias("key"), F.lit(-1).cast("long").alias("pos"), "value")
    else:
        put = moved.select(F.lit(dst).alias("key"), F.lit(2**62).cast("long").alias("pos"), "value")
    return _dense(rest.select("key", "pos", "value").union(put))


def blocking_pick(lists: DataFrame, requested: DataFrame, side: str = "LEFT") -> DataFrame:
    """``client, key, value``: each client of ``requested(client, key_pos, key)`` gets the end of its first list that isn't empty."""
    ends = lpop(lists) if side == "LEFT" else rpop(lists)
    best = requested.join(ends, "key").groupBy("client").agg(F.min(F.struct("key_pos", "key", "value")).alias("x"))
    return requested.select("client").distinct().join(best, "client", "left").select("client", "x.key", "x.value")


def blocking_pops(log: DataFrame) -> DataFrame:
    """``client, key, value, at``: what waiting clients get, and at which ``seq`` they are served.

    ``log(key, seq, op, arg)`` has pushes to the tail (PUSH, ``arg`` the value)
    and BLPOPs without a time limit (WAIT, ``arg`` the client). Clients are
    served in order, so the n-th of a key gets the n-th value pushed, as soon as
    both are there; those that still wait at the end are left out.
    """
    n = F.row_number().over(Window.partitionBy("key", "op").orderBy("seq"))
    numbered = log.withColumn("_n", n)
    pushes = numbered.where("op = 'PUSH'").select("key", "_n", F.col("arg").alias("value"), F.col("seq").alias("_pushed"))
    waits = numbered.where("op = 'WAIT'").select("key", "_n", F.col("arg").alias("client"), F.col("seq").alias("_asked"))
    return waits.join(pushes, ["key", "_n"]).select("client", "key", "value", F.greatest("_pushed", "_asked").alias("at"))


def to_arrays(lists: DataFrame) -> DataFrame:
    """``key, items``."""
    return lists.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("items"))
