"""Time series as ``(key, ts, value)`` rows, ts in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def accept(samples: DataFrame) -> DataFrame:
    """``samples(key, seq, ts, value)`` that aren't older than an earlier one of their key."""
    run = F.max("ts").over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return samples.withColumn("_top", run).where("ts >= _top").drop("_top")


def overwrite(samples: DataFrame) -> DataFrame:
    """One row for each key and time: the last written."""
    return samples.groupBy("key", "ts").agg(F.max_by("value", "seq").alias("value"))


def retain(series: DataFrame, retention_ms: int) -> DataFrame:
    """Samples no older than the retention before their key's last. The last is a grouped maximum, joined back."""
    last = series.groupBy("key").agg(F.max("ts").alias("_last"))
    return series.join(last, "key").where(F.col("ts") >= F.col("_last") - retention_ms).drop("_last")


def create(meta: DataFrame, writes: DataFrame) -> DataFrame:
    """``key, retention_ms`` after TS.CREATE of ``writes(key, retention_ms, seq)``: the last retention given, 0 without any."""
    every = meta.select("key", "retention_ms", F.lit(None).cast(writes.schema["seq"].dataType).alias("seq"), F.lit(0).alias("_new")).union(writes.select("key", "retention_ms", "seq", F.lit(1).alias("_new")))
    given = F.when(F.col("retention_ms").isNotNull(), F.struct("_new", "seq"))
    return every.groupBy("key").agg(F.coalesce(F.max_by("retention_ms", given), F.lit(0)).cast("long").alias("retention_ms"))


def retain_each(series: DataFrame, meta: DataFrame) -> DataFrame:
    """Samples that their key's ``meta(key, retention_ms)`` keeps; 0 and keys without it keep all."""
    last = series.groupBy("key").agg(F.max("ts").alias("_last")).join(meta.select("key", "retention_ms"), "key", "left")
    oldest = F.when(F.coalesce("retention_ms", F.lit(0)) > 0, F.col("_last") - F.col("retention_ms"))
    return series.join(last.select("key", oldest.alias("_oldest")), "key").where("_oldest IS NULL OR ts >= _oldest").drop("_oldest")


def add(samples: DataFrame, retention_ms: int | None = None) -> DataFrame:
    """What a sequence of TS.ADD leaves."""
    out = overwrite(accept(samples))
    return out if retention_ms is None else retain(out, retention_ms)


def last(series: DataFrame) -> DataFrame:
    return series.groupBy("key").agg(F.max_by(F.struct("ts", "value"), "ts").alias("x")).select("key", "x.*")


def between(series: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    out = series if start is None else series.where(F.col("ts") >= start)
    return out if end is None else out.where(F.col("ts") <= end)


def buckets(series: DataFrame, start: int, end: int, agg: str, bucket_ms: int) -> DataFrame:
    """``key, bucket, value``: buckets begin at ``start``; empty ones are left out."""
    at = F.floor((F.col("ts") - start) / bucket_ms).cast("long") * bucket_ms + start
    return between(series, start, end).groupBy("key", at.alias("bucket")).agg(AGGREGATES[agg]("value").alias("value"))


def rule(series: DataFrame, agg: str, bucket_ms: int) -> DataFrame:
    """What a compaction rule fills its destination with: buckets aligned to time 0."""
    at = F.floor(F.col("ts") / bucket_ms).cast("long") * bucket_ms
    return series.groupBy("key", at.alias("bucket")).agg(AGGREGATES[agg]("value").alias("value"))


def rules(series: DataFrame, table: DataFrame) -> DataFrame:
    """``table(src, dst, agg, bucket_ms)`` applied at once: ``key`` is the destination."""
    at = F.floor(F.col("ts") / F.col("bucket_ms")).cast("long") * F.col("bucket_ms")
    g = series.join(table, F.col("key") == F.col("src")).groupBy("dst", "agg", at.alias("bucket")).agg(*(f("value").alias(k) for k, f in AGGREGATES.items()))
    pick = F.coalesce(*(F.when(F.col("agg") == k, F.col(k)) for k in AGGREGATES))
    return g.select(F.col("dst").alias("key"), "bucket", pick.alias("value"))
