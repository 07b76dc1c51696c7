"""String values: lookups, upserts, counters and slices, over ``(key, value)`` tables or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INT64 = r"^-?[0-9]+$"


def get(kv: DataFrame, key_value) -> DataFrame:
    return kv.where(F.col("key") == key_value)


def mget(kv: DataFrame, requested: DataFrame) -> DataFrame:
    """``requested(pos, key)`` with each value, null where there is none."""
    return requested.join(kv, "key", "left").select("pos", "key", "value")


def _latest(writes: DataFrame, pick: str) -> DataFrame:
    by = {"last": F.max_by, "first": F.min_by}[pick]
    return writes.groupBy("key").agg(by("value", "seq").alias("value"))


def set_last(writes: DataFrame) -> DataFrame:
    """``writes(key, value, seq)``: what SET leaves, the last value of each key."""
    return _latest(writes, "last")


def set_if_absent(writes: DataFrame) -> DataFrame:
    """What SETNX (or SET NX) leaves: the first value of each key."""
    return _latest(writes, "first")


def set_if_present(kv: DataFrame, writes: DataFrame) -> DataFrame:
    """What SET XX leaves: only keys that exist already take their last value."""
    last = set_last(writes).withColumnRenamed("value", "_new")
    return kv.join(last, "key", "left").select("key", F.coalesce("_new", "value").alias("value"))


def mset(kv: DataFrame, pairs: DataFrame) -> DataFrame:
    """``kv`` with ``pairs(key, value, pos)`` written over it; of a repeated key the last counts."""
    new = pairs.select("key", "value", F.col("pos").cast("long").alias("seq"))
    return set_last(kv.select("key", "value", F.lit(-1).cast("long").alias("seq")).union(new))


def msetnx(kv: DataFrame, pairs: DataFrame) -> DataFrame:
    """``txn, done``: each transaction of ``pairs(txn, key)`` is done only if none of its keys exists."""
    there = pairs.join(kv.select("key", F.lit(1).alias("_there")).distinct(), "key", "left")
    return there.groupBy("txn").agg(F.bool_and(F.col("_there").isNull()).alias("done"))


def set_with_expiry(writes: DataFrame, now: Column) -> DataFrame:
    """``writes(key, value, seq, ttl_s)``: value and ``expire_at``; a ttl that isn't positive is an error row, left out."""
    due = F.timestamp_millis(F.unix_millis(now) + F.col("ttl_s") * 1000)
    return writes.where("ttl_s > 0").groupBy("key").agg(F.max_by(F.struct("value", due.alias("expire_at")), "seq").alias("x")).select("key", "x.*")


def set_replies(kv: DataFrame, writes: DataFrame) -> DataFrame:
    """``writes`` with ``done`` and ``old_value``, for SET with its options in order of ``seq``.

    ``kv(key, value, due_ms)`` is what is there, ``writes(key, value, seq, cond,
    keep_ttl, due_ms)`` has NX, XX or null as ``cond``. A key exists once any
    write without XX came before, so no write needs the outcome of another.
    ``old_value`` is the reply of the option GET.
    """
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    there = kv.select("key", F.col("value").alias("_base"), F.lit(1).alias("_there"))
    exists = F.col("_there").isNotNull() | F.coalesce(F.max(F.when(F.col("cond") == "XX", 0).otherwise(1)).over(before) == 1, F.lit(False))
    done = F.when(F.col("cond") == "NX", ~F.col("_exists")).when(F.col("cond") == "XX", F.col("_exists")).otherwise(True)
    old = F.coalesce(F.last(F.when(F.col("done"), F.col("value")), ignorenulls=True).over(before), "_base")
    return writes.join(there, "key", "left").withColumn("_exists", exists).withColumn("done", done).withColumn("old_value", old).drop("_base", "_there", "_exists")


def set_state(kv: DataFrame, replies: DataFrame) -> DataFrame:
    """``key, value, due_ms`` that the ``set_replies`` leave; KEEPTTL leaves the time to live, other writes set or clear it."""
    done = replies.where("done")
    last = done.groupBy("key").agg(F.max_by("value", "seq").alias("_value"), F.max_by(F.when(~F.col("keep_ttl") | F.col("due_ms").isNotNull(), F.struct("due_ms")), F.when(~F.col("keep_ttl") | F.col("due_ms").isNotNull(), F.col("seq"))).alias("_due"))
    due = F.when(F.col("_due").isNotNull(), F.col("_due.due_ms")).otherwise(F.col("due_ms"))
    return kv.join(last, "key", "full").select("key", F.coalesce("_value", "value").alias("value"), due.alias("due_ms"))


def get_ex(kv: DataFrame, requested: DataFrame, now_ms: Column) -> tuple[DataFrame, DataFrame]:
    """What GETEX returns, and the table it leaves.

    ``kv(key, value, due_ms)``; ``requested(key, mode, amount)`` with EX or PX
    and a positive amount, PERSIST, or null to read only. Amounts that aren't
    positive are errors: they have ``ok`` false, no value and no effect.
    """
    timed = F.col("mode").isin("EX", "PX")
    ok = ~F.coalesce(timed, F.lit(False)) | F.coalesce(F.col("amount") > 0, F.lit(False))
    asked = requested.withColumn("ok", ok)
    replies = asked.join(kv.select("key", "value"), "key", "left").select("key", "mode", "ok", F.when(F.col("ok"), F.col("value")).alias("value"))
    due = F.when(F.col("mode") == "PERSIST", F.lit(None).cast("long")).when(F.col("mode") == "EX", now_ms + F.col("amount") * 1000).when(F.col("mode") == "PX", now_ms + F.col("amount")).otherwise(F.col("due_ms"))
    left = kv.join(asked.where("ok").select("key", "mode", "amount"), "key", "left").select("key", "value", due.cast("long").alias("due_ms"))
    return replies, left


def get_set(writes: DataFrame) -> DataFrame:
    """``writes`` with ``old_value``, what GETSET returned."""
    return writes.withColumn("old_value", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def get_delete(kv: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What GETDEL returns, and what it leaves."""
    return kv.join(wanted.select("key"), "key", "left_semi"), kv.join(wanted.select("key"), "key", "left_anti")


def append(value: Column, suffix: Column) -> Column:
    return F.concat(F.coalesce(value, F.lit("")), suffix)


def append_all(writes: DataFrame) -> DataFrame:
    """``key, value``: all appended values in order of ``seq``."""
    return writes.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "").alias("value"))


def strlen(value: Column) -> Column:
    """UTF-8 bytes, 0 for no value."""
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def getrange(value: Column, start: int, end: int) -> Column:
    """Characters from ``start`` to ``end``, both included and counted from the end where negative."""
    n = F.length(value)
    lo = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    hi = F.least(F.lit(end) if end >= 0 else n + end, n - 1)
    return F.when(hi >= lo, F.substring(value, lo + 1, hi - lo + 1)).otherwise("")


def setrange(value: Column, offset: int, new: Column) -> Column:
    """Overwritten from ``offset``; a gap is filled with NUL."""
    filled = F.rpad(value, F.greatest(F.length(value), F.lit(offset)), "\0")
    return F.overlay(filled, new, F.lit(offset + 1))


def incr(value: Column, by: Column | int = 1) -> Column:
    """Null where the value isn't an integer of 64 bits, or the sum isn't."""
    v = F.coalesce(value, F.lit("0"))
    return F.when(v.rlike(INT64), F.try_add(v.try_cast("long"), F.lit(by).cast("long") if isinstance(by, int) else by.cast("long")))


def incr_float(value: Column, by: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0)) + by


def counters(log: DataFrame) -> DataFrame:
    """Running counters over a log ``(key, seq, op, n)``, where op is SET, INCR or DEL.

    A SET or DEL begins a segment; within it the counter is the running sum.
    """
    w = Window.partitionBy("key").orderBy("seq")
    seg = F.sum(F.when(F.col("op").isin("SET", "DEL"), 1).otherwise(0)).over(w)
    delta = F.when(F.col("op") == "DEL", 0).otherwise(F.col("n"))
    run = F.sum("_delta").over(Window.partitionBy("key", "_seg").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("_seg", seg).withColumn("_delta", delta.cast("long")).withColumn("counter", run).drop("_seg", "_delta")


def counters_now(log: DataFrame) -> DataFrame:
    """``key, counter``: only what is left at the end; two aggregates instead of windows over every row."""
    last = log.where(F.col("op").isin("SET", "DEL")).groupBy("key").agg(F.max("seq").alias("_from"), F.max_by(F.when(F.col("op") == "SET", F.col("n")).otherwise(0), "seq").alias("_base"))
    after = log.where(F.col("op") == "INCR").join(last, "key", "left").where("_from IS NULL OR seq > _from").groupBy("key").agg(F.sum("n").alias("_sum"))
    return last.join(after, "key", "full").select("key", (F.coalesce("_base", F.lit(0)) + F.coalesce("_sum", F.lit(0))).cast("long").alias("counter"))
