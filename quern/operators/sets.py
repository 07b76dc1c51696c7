"""Sets as distinct ``(key, member)`` rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sadd(rows: DataFrame) -> DataFrame:
    return rows.select("key", "member").distinct()


def srem(sets: DataFrame, dropped: DataFrame) -> DataFrame:
    return sets.join(dropped.select("key", "member").distinct(), ["key", "member"], "left_anti")


def sismember(sets: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes(key, member)`` with ``present``, 0 or 1."""
    there = sets.select("key", "member", F.lit(1).alias("_there"))
    return probes.join(there, ["key", "member"], "left").select("key", "member", F.coalesce("_there", F.lit(0)).alias("present"))


def smembers(sets: DataFrame, key) -> DataFrame:
    return sets.where(F.col("key") == key).select("member")


def scard(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count("*").alias("n_members"))


def sinter(sets: DataFrame, keys: list) -> DataFrame:
    """Members of all the sets: one count by member over one scan, whatever the number of sets."""
    keys = list(dict.fromkeys(keys))
    return sets.where(F.col("key").isin(keys)).groupBy("member").agg(F.count("*").alias("_n")).where(F.col("_n") == len(keys)).select("member")


def sunion(sets: DataFrame, keys: list) -> DataFrame:
    return sets.where(F.col("key").isin(keys)).select("member").distinct()


def sdiff(sets: DataFrame, first, rest: list) -> DataFrame:
    other = sets.where(F.col("key").isin(rest)).select("member")
    return smembers(sets, first).join(other, "member", "left_anti")


def store(sets: DataFrame, dest, members: DataFrame) -> DataFrame:
    """``sets`` with ``members`` as the set ``dest``, in place of what was there."""
    return sets.where(F.col("key") != dest).select("key", "member").union(members.select(F.lit(dest).alias("key"), "member"))


def smove(sets: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves(src, dst, member)``: members leave src and join dst, if src has them."""
    done = moves.join(sets.select(F.col("key").alias("src"), "member"), ["src", "member"], "left_semi")
    left = srem(sets, done.select(F.col("src").alias("key"), "member"))
    return left.select("key", "member").union(done.select(F.col("dst").alias("key"), "member")).distinct()


def _shuffled(sets: DataFrame, seed: int):
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "member", F.lit(seed)), "member"))


def srandmember(sets: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """``count`` members of each set: distinct, or drawn with replacement where negative."""
    n = sets.withColumn("_n", _shuffled(sets, seed))
    if count >= 0:
        return n.where(F.col("_n") <= count).select("key", "member")
    size = scard(sets)
    draws = size.select("key", F.posexplode(F.sequence(F.lit(1), F.lit(-count))).alias("draw", "_d"), "n_members")
    draws = draws.withColumn("_n", (F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.col("n_members")) + 1).cast("int"))
    return draws.join(n, ["key", "_n"]).select("key", "member")


def spop(sets: DataFrame, count: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """What SPOP returns, and what it leaves."""
    popped = srandmember(sets, abs(count), seed)
    return popped, srem(sets, popped)


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
