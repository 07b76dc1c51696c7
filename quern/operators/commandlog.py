"""Folding an ordered log of commands, ``(seq, db, cmd, key, arg)``, into the state it leaves.

Where a command overwrites or adds, the fold is grouped aggregates. Commands
whose effect depends on the value so far, in any order, are folded key by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import folds
from quern.sources import aof

#: Bytes of the stream that a replica may lie behind.
BACKLOG = 1 << 20

OVERWRITES, BARRIERS = ("SET",), ("DEL", "FLUSH")


def last_flush(log: DataFrame) -> DataFrame:
    """``db, flushed``: the last FLUSHDB of each database."""
    return log.where("cmd = 'FLUSHDB'").groupBy("db").agg(F.max("seq").alias("flushed"))


def since_barriers(log: DataFrame) -> DataFrame:
    """Commands on keys after their database's last FLUSHDB and their own last DEL."""
    after = log.where("cmd <> 'FLUSHDB'").join(F.broadcast(last_flush(log)), "db", "left").where("flushed IS NULL OR seq > flushed").drop("flushed")  # a row for each database
    dels = after.where("cmd = 'DEL'").groupBy("db", "key").agg(F.max("seq").alias("deleted"))
    return after.where("cmd <> 'DEL'").join(dels, ["db", "key"], "left").where("deleted IS NULL OR seq > deleted").drop("deleted")


def strings(log: DataFrame) -> DataFrame:
    """``db, key, value`` left by SET, DEL and FLUSHDB."""
    return since_barriers(log.where(F.col("cmd").isin("SET", "DEL", "FLUSHDB"))).groupBy("db", "key").agg(F.max_by("arg", "seq").alias("value"))


def transactions(log: DataFrame) -> DataFrame:
    """``log`` without the commands of transactions that weren't executed.

    ``log(seq, cmd, key, arg, txn)``: queued commands carry the number of their
    transaction, and EXEC or DISCARD ends it; commands take effect at EXEC.
    """
    ends = log.where(F.col("cmd").isin("EXEC", "DISCARD")).select("txn", F.col("cmd").alias("_end"), F.col("seq").alias("_at"))
    body = log.where(~F.col("cmd").isin("MULTI", "EXEC", "DISCARD"))
    done = body.join(ends, "txn", "left").where("txn IS NULL OR _end = 'EXEC'")
    return done.withColumn("effect", F.struct(F.coalesce("_at", "seq").alias("at"), F.col("seq").alias("seq"))).drop("_end", "_at")


def expiring(log: DataFrame, now) -> DataFrame:
    """``key, value`` alive at ``now``: SET clears the expiry, EXPIRE sets it (``arg`` milliseconds after ``ts``)."""
    last_set = log.where("cmd = 'SET'").groupBy("key").agg(F.max_by(F.struct(F.col("arg").alias("value"), F.col("seq").alias("set_seq")), "seq").alias("s")).select("key", "s.*")
    due = log.where("cmd = 'EXPIRE'").join(last_set, "key").where("seq > set_seq").groupBy("key").agg(F.max_by(F.unix_millis("ts") + F.col("arg").cast("long"), "seq").alias("due"))
    return last_set.join(due, "key", "left").where(F.col("due").isNull() | (F.col("due") > F.unix_millis(now))).select("key", "value")


def fold_lists(log: DataFrame) -> DataFrame:
    """``key, items`` after all commands on lists of ``log(key, seq, cmd, arg)``; several arguments are separated by spaces.

    LPUSH, RPUSH, LPOP, RPOP, LSET, LTRIM, LREM and DEL take effect; any other raises.
    """
    known = "LPUSH RPUSH LPOP RPOP LSET LTRIM LREM DEL".split()
    bad = F.raise_error(F.concat(F.col("cmd"), F.lit(" is no command on a list")))
    many = F.col("cmd").isin("LSET", "LTRIM", "LREM")
    args = F.when(F.col("arg").isNull() | F.col("cmd").isin("LPOP", "RPOP", "DEL"), F.array().cast("array<string>")).when(many, F.split("arg", " ", 2)).otherwise(F.array("arg"))
    each = log.select(F.lit(0).alias("db"), "key", "seq", F.when(F.col("cmd").isin(known), F.col("cmd")).otherwise(bad).alias("cmd"), args.alias("args"))
    left = folds.fold(each).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x"))
    empty = F.array().cast("array<string>")
    return log.select("key").distinct().join(left, "key", "left").select("key", F.coalesce(F.transform("x", lambda v: v["value"]), empty).alias("items"))


def offsets(log: DataFrame) -> DataFrame:
    """``log(seq, args)`` with ``ends``, the byte of the replication stream behind each command.

    Running sums go over ranges of ``seq`` and then within them, so no task has
    the whole log.
    """
    sized = log.withColumn("_n", F.octet_length(aof.encode_command(F.col("args"))) + 2)
    span = sized.agg(F.min("seq").alias("_lo"), (F.floor((F.max("seq") - F.min("seq")) / 1024) + 1).alias("_width"))
    part = F.floor((F.col("seq") - F.col("_lo")) / F.col("_width"))
    dealt = sized.crossJoin(F.broadcast(span)).withColumn("_part", part).drop("_lo", "_width")  # one row
    upto = lambda n, own: F.sum(n).over(Window.partitionBy(*own).orderBy("seq" if own else "_part").rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    before = dealt.groupBy("_part").agg(F.sum("_n").alias("_sum")).withColumn("_before", F.coalesce(upto("_sum", []), F.lit(0)))  # at most 1,024 rows
    return dealt.withColumn("_within", upto("_n", ["_part"])).join(before, "_part").withColumn("ends", (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_n", "_sum", "_before", "_within")


def psync(log: DataFrame, replid: str, asked: str, offset: int, backlog: int = BACKLOG) -> tuple[str, DataFrame]:
    """CONTINUE or FULLRESYNC for a replica that has the stream of ``asked`` up to ``offset``, and the commands it still needs.

    It may go on while its offset lies within the last ``backlog`` bytes and at
    the end of a command of the same history; else it needs a snapshot and the
    commands after that.
    """
    stream = offsets(log)
    last = stream.agg(F.coalesce(F.max("ends"), F.lit(0)).alias("x")).first().x
    at_end = offset == 0 or stream.where(F.col("ends") == offset).take(1)
    if asked == replid and last - backlog <= offset <= last and at_end:
        return "CONTINUE", stream.where(F.col("ends") > offset)
    return "FULLRESYNC", stream.where(F.lit(False))


def catch_up(log: DataFrame, applied: int, limit: int | None = None) -> DataFrame:
    """What a replica still has to apply; the filter reaches the scan."""
    out = log.where(F.col("seq") > applied)
    return out if limit is None else out.orderBy("seq").limit(limit)


def numbered(log: DataFrame, *order: str) -> DataFrame:
    """A log with ``seq`` by key: what is folded needs an order within keys only."""
    return log.withColumn("seq", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
