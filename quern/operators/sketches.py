"""HyperLogLog registers and cuckoo filters as relations.

Registers ``(key, idx, rho)`` merge by maximum, so counting is two grouped
aggregates whose partial results are at most 16,384 rows a key and task.

An item's two buckets in a cuckoo filter are a fixed pair, and moving a
fingerprint never leaves its pair; so ``(key, fp, lo, hi, n)`` answers as the
filter does for as long as every insert finds a place. ``cf_fill`` places items
one by one under a capacity, and tells which find no place.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shared import ship

P = 14
M = 1 << P
ALPHA = 0.7213 / (1 + 1.079 / M)
FNV_BASE, FNV_PRIME = 2166136261, 16777619


def sha1_prefix(item: Column) -> Column:
    """The first four bytes of the SHA-1 digest, as a number."""
    return F.conv(F.substring(F.sha1(item), 1, 8), 16, 10).cast("long")


def pfadd(items: DataFrame) -> DataFrame:
    """Registers of ``items(key, item)``: 14 bits choose one, the rest gives the rank of its first set bit."""
    h = sha1_prefix(F.col("item"))
    tail = h.bitwiseAND(F.lit((1 << 18) - 1))
    rho = F.when(tail == 0, 19).otherwise(19 - F.length(F.bin(tail)))
    return items.select("key", F.shiftright(h, 18).cast("int").alias("idx"), rho.cast("int").alias("rho")).groupBy("key", "idx").agg(F.max("rho").alias("rho"))


def pfadd_changed(before: DataFrame, added: DataFrame) -> DataFrame:
    """``key, changed``: 1 where a register of ``added`` exceeds what was there."""
    old = before.select("key", "idx", F.col("rho").alias("_old"))
    return added.join(old, ["key", "idx"], "left").groupBy("key").agg(F.bool_or(F.col("rho") > F.coalesce("_old", F.lit(0))).cast("int").alias("changed"))


def estimate(registers: DataFrame, *by: str) -> DataFrame:
    """``n_distinct``: the raw estimate, or linear counting while it is small and registers are empty."""
    s = registers.groupBy(*by).agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("s"))
    zeros = F.lit(M) - F.col("used")
    raw = F.lit(ALPHA * M * M) / (F.col("s") + zeros)
    out = F.when((raw <= 2.5 * M) & (zeros > 0), M * F.log(F.lit(float(M)) / zeros)).otherwise(raw)
    return s.select(*by, F.round(out).cast("long").alias("n_distinct"))


def pfcount(registers: DataFrame) -> DataFrame:
    return estimate(registers, "key")


def pfmerge(registers: DataFrame, keys: list, dest=None) -> DataFrame:
    """Registers of the union of the sources; what the destination held before doesn't count."""
    out = registers.where(F.col("key").isin(keys)).groupBy("idx").agg(F.max("rho").alias("rho"))
    return out if dest is None else out.select(F.lit(dest).alias("key"), "idx", "rho")


def pfcount_union(registers: DataFrame, keys: list) -> DataFrame:
    return estimate(pfmerge(registers, keys))


def native_distinct(items: DataFrame) -> DataFrame:
    """The engine's own sketch, for counts that needn't agree with the registers."""
    return items.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("item", F.lit(P))).alias("n_distinct"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G....)"), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("long"))
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(codes, F.lit(FNV_BASE).cast("long"), step)


def buckets_of(capacity: int = 1024, bucket_size: int = 4) -> int:
    """CF.RESERVE: the next power of two of capacity over bucket size."""
    n = 1
    while n < capacity // bucket_size:
        n *= 2
    return n


def cf_place(items: DataFrame, buckets: int = 256) -> DataFrame:
    """``items`` with the fingerprint and the pair of buckets of ``item``."""
    return _placed(items, buckets).drop("_first")


def _placed(items: DataFrame, buckets: int) -> DataFrame:
    h = F.col("_h")
    out = items.withColumn("_h", fnv1a(F.col("item").cast("string")))
    mark = h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(F.lit(255))
    out = out.withColumn("fp", F.when(mark == 0, 1).otherwise(mark).cast("int"))
    out = out.withColumn("_first", h.bitwiseAND(F.lit(buckets - 1))).withColumn("_second", F.col("_first").bitwiseXOR(fnv1a(F.col("fp").cast("string"))).bitwiseAND(F.lit(buckets - 1)))
    return out.withColumns({"lo": F.least("_first", "_second"), "hi": F.greatest("_first", "_second")}).drop("_h", "_second")


def cf_fill(items: DataFrame, capacity: int = 1024, bucket_size: int = 4, kicks: int = 500, only_new: bool = False, seed: int = 1) -> DataFrame:
    """``items(key, item, seq)`` with ``added``, 1 or 0, for a filter of each key that was reserved with a capacity.

    An item goes into one of its two buckets, or takes the place of another,
    which moves to its own other bucket, up to ``kicks`` times; then the filter
    is full, the item is not added, and the last one moved is lost, as in the
    original. With ``only_new`` items that seem to be there aren't added, and a
    null item never is. Items are placed with expressions; a key's filter, which
    its capacity bounds, is filled by one task in order of ``seq``, batch by
    batch as the rows come from the sort.
    """
    buckets = buckets_of(capacity, bucket_size)
    ship(items.sparkSession)
    placed = _placed(items, buckets).select("key", "item", "seq", "fp", "lo", "hi", F.col("_first").alias("first"))
    in_order = placed.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("seq"), "item")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rng, held, pair = object(), None, {}, {}
        for t in batches:
            added = []
            for key, fp, lo, hi, first in zip(*(t.column(c).to_pylist() for c in ("key", "fp", "lo", "hi", "first")), strict=True):
                if key != now:
                    now, rng, held, pair = key, random.Random(seed), {}, {}
                if fp is None:
                    added.append(0)
                    continue
                pair.setdefault(fp, lo ^ hi)  # the two buckets of a fingerprint differ by its own hash
                second = lo if first == hi else hi
                own, other = held.setdefault(first, []), held.setdefault(second, [])
                if only_new and (fp in own or fp in other):
                    added.append(0)
                    continue
                done = next((b for b in (own, other) if len(b) < bucket_size), None)
                if done is not None:
                    done.append(fp)
                    added.append(1)
                    continue
                i, f, ok = rng.choice((first, second)), fp, 0
                for _ in range(kicks):
                    at = rng.randrange(bucket_size)
                    held[i][at], f = f, held[i][at]
                    i ^= pair[f]
                    if len(held.setdefault(i, [])) < bucket_size:
                        held[i].append(f)
                        ok = 1
                        break
                added.append(ok)
            yield pa.RecordBatch.from_arrays([t.column("key"), t.column("item"), t.column("seq"), pa.array(added, pa.int32())], ["key", "item", "seq", "added"])

    kinds = {c: items.schema[c].dataType.simpleString() for c in ("key", "item", "seq")}
    return in_order.mapInArrow(fill, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", added int")


def cf_add(items: DataFrame, buckets: int = 256) -> DataFrame:
    """``key, fp, lo, hi, n``: duplicates count."""
    return cf_place(items, buckets).groupBy("key", "fp", "lo", "hi").agg(F.count("*").alias("n"))


def cf_addnx(items: DataFrame, buckets: int = 256) -> DataFrame:
    """``items(key, item, seq)`` with ``added``: 1 where nothing like it was there."""
    n = F.row_number().over(Window.partitionBy("key", "fp", "lo", "hi").orderBy("seq"))
    return cf_place(items, buckets).withColumn("added", (n == 1).cast("int"))


def cf_exists(cf: DataFrame, probes: DataFrame, buckets: int = 256) -> DataFrame:
    """``probes(key, item)`` with ``present``; false positives happen."""
    there = cf.where("n > 0").select("key", "fp", "lo", "hi", F.lit(1).alias("_there"))
    return cf_place(probes, buckets).join(there, ["key", "fp", "lo", "hi"], "left").withColumn("present", F.coalesce("_there", F.lit(0))).select(*probes.columns, "present")


def cf_delete(cf: DataFrame, items: DataFrame, buckets: int = 256) -> DataFrame:
    """One fingerprint less for each item, where there is one."""
    gone = cf_add(items, buckets).withColumnRenamed("n", "_d")
    left = cf.join(gone, ["key", "fp", "lo", "hi"], "left").withColumn("n", F.col("n") - F.coalesce("_d", F.lit(0)))
    return left.where("n > 0").drop("_d")
