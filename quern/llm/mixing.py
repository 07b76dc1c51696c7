"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the source's words up to
and including it, in shuffled order, over the source's target. All copies are
then ordered by finish time and cut where the total budget is spent, so each
source has delivered the same share of its target at the cut.

Running sums over a source, and over the whole corpus, never pass through one
task: rows fall into buckets of a bounded mean size by shuffle key (or finish
time), the sums of the buckets are accumulated in two levels, and only inside a
bucket does a window run. The cut is found in the same way, which takes the
place of a sort of all copies: it is where a global range-sort would truncate.
Only the sources themselves, a row each, are put in order by one task. The plan
is DataFrame operations throughout.

Cases: a null text has size 0 and is never taken; null is a source of its own,
the last; the shuffle key is the digest of id and text, so rows whose id is null
or repeated don't gather in a bucket; rows that tie are ordered by a hash of all
their columns, and those alike in all are taken on their own; a source without
words has target 0; a very long text is one document, taken whole or not; an
empty table gives an empty result; result columns win over input columns of the
same name.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import n_words, packed, unpacked, whole
from quern.shared import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Mean rows of a bucket.
BUCKET_ROWS = 1024
KEY_BITS = 60


def shuffle_key(doc_id: Column, digest: Column, seed: int) -> Column:
    """60 bits of the digest of seed, id and the text's digest: the same order in every run."""
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest))
    return F.conv(F.substring(own, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, copies: int) -> DataFrame:
    """``totals(s_null, s, source_size)`` with ``s_rank`` and ``target``.

    The budget, ``share`` of all sizes, is dealt by weight; a target stops at
    ``copies`` times its source's size and what it leaves is dealt again. In
    order of that stop over weight, the stopped sources come first, so sums
    over the order replace the loop.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name, by_stop = Window.orderBy("s_null", "s"), Window.orderBy("stop_level", "s_rank")
    size = F.col("source_size").cast("double")
    dealt = (
        totals.withColumn("s_rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("s_rank") - 1, F.lit(len(weights))) + 1).cast("double"))
        .withColumn("stop", size * copies)
        .withColumn("stop_level", F.col("stop") / F.col("weight"))
        .withColumn("budget", F.sum(size).over(everything) * share)
        .withColumn("before", F.coalesce(F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stopped", F.col("stop_level") * F.col("weight_left") <= F.col("budget") - F.col("before"))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("stop"))).over(everything), F.lit(0.0))) / F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("stopped"), F.col("stop")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("stop")))
    return dealt.select("s_null", "s", "source_size", "s_rank", "budget", target.alias("target"))


def _keyed(df: DataFrame, bits: int, seed: int) -> DataFrame:
    return df.withColumns({
        "_s_null": F.col("_source").isNull(), "_s": F.coalesce(F.col("_source").cast("string"), F.lit("")), "_key": shuffle_key(F.col("_id"), F.col("_digest"), seed),
    }).withColumn("_kb", F.shiftright("_key", KEY_BITS - bits) if bits else F.lit(0).cast("long"))


def _before(sums: DataFrame, keys: list[str], order: str, value: str, bits: int) -> DataFrame:
    """``sums`` with ``before``: the ``value`` of the rows that come before by ``order``, a whole number of ``bits`` bits.

    Sums run within parts of the order and over the parts, so that no task has them all.
    """
    sums = sums.withColumn("_part", F.shiftright(order, bits // 2))
    upto = lambda own, by: F.coalesce(F.sum(value).over(Window.partitionBy(*own).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy(*keys, "_part").agg(F.sum(value).alias(value))
    parts = parts.withColumn("_earlier", upto(keys or [F.lit(0)], "_part")).drop(value)
    return sums.withColumn("_within", upto([*keys, "_part"], order)).join(parts, [*keys, "_part"]).withColumn("before", F.col("_earlier") + F.col("_within")).drop("_part", "_earlier", "_within")


def _finish_times(keyed: DataFrame, starts: DataFrame, copies: int) -> DataFrame:
    """``keyed`` with an array ``_copies`` of order keys, one for each copy the source may give."""
    inside = Window.partitionBy("_s_null", "_s", "_kb").orderBy("_key", F.col("_id").asc_nulls_first(), "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_start") + F.sum("_size").over(inside)
    one = lambda p: F.struct(
        ((F.lit(float(p)) * F.col("_source_size") + F.col("_at")) / F.col("_target")).alias("t"), F.col("_s_rank").alias("r"), F.lit(p).alias("p"), F.col("_key").alias("k"),
    )
    return keyed.join(starts, ["_s_null", "_s", "_kb"]).withColumn("_at", at).withColumn(
        "_copies", F.when((F.col("_target") > 0) & (F.col("_size") > 0), F.array(*map(one, range(copies)))),
    )


def mix_sources(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = MOST_COPIES, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, digest_col: str | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, the words the mix takes of each row.

    ``taken`` is a whole number of copies of the row, at most ``copies``. Sizes
    and digests (MD5) of the texts are taken from columns where these are named.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    size = F.col(size_col).cast("long") if size_col else n_words(whole(text_col))
    tie = F.xxhash64(*(f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()))
    digest = F.col(digest_col) if digest_col else F.md5(whole(text_col).cast("binary"))
    parts = {"_id": F.col(id_col), "_source": F.col(source_col), "_size": size, "_digest": digest, "_tie": tie}
    narrow = scratch.put(docs.select(*(e.alias(k) for k, e in parts.items())))
    rows = narrow.count()
    bits = min(KEY_BITS, max(0, ceil(log2(max(1, rows) / BUCKET_ROWS))))

    keyed = _keyed(narrow, bits, seed)
    buckets = scratch.put(keyed.groupBy("_s_null", "_s", "_kb").agg(F.sum("_size").alias("bucket_size")))
    totals = buckets.groupBy(F.col("_s_null").alias("s_null"), F.col("_s").alias("s")).agg(F.sum("bucket_size").alias("source_size"))
    targets = scratch.put(source_targets(totals, weights, share, copies))
    starts = scratch.put(
        _before(buckets, ["_s_null", "_s"], "_kb", "bucket_size", bits).withColumnRenamed("before", "_start")
        .join(targets, (F.col("_s_null") == F.col("s_null")) & (F.col("_s") == F.col("s")))
        .select("_s_null", "_s", "_kb", "_start", F.col("source_size").alias("_source_size"), F.col("s_rank").alias("_s_rank"), F.col("target").alias("_target")),
    )
    cut = _cut(scratch, _finish_times(keyed, starts, copies), targets, rows)

    timed = _finish_times(_keyed(packed(docs, **parts), bits, seed), starts, copies)
    taken = F.lit(0).cast("long")
    if cut is not None:
        last = F.struct(F.lit(cut.t).alias("t"), F.lit(cut.r).alias("r"), F.lit(cut.p).alias("p"), F.lit(cut.k).cast("long").alias("k"))
        taken = F.when(F.col("_copies").isNull(), taken).otherwise(F.size(F.filter("_copies", lambda c: c <= last)).cast("long") * F.col("_size"))
    return unpacked(timed, docs.columns, size=F.col("_size"), source_size=F.col("_source_size"), target=F.col("_target"), taken=taken)


def _cut(scratch: Scratch, timed: DataFrame, targets: DataFrame, rows: int):
    """The order key of the last copy inside the budget, or None if no copy is.

    Finish times fall into slots; sums of the slots find the one where the
    budget runs out, and only that slot's copies are put in order.
    """
    slots = max(64, ceil(rows / BUCKET_ROWS))
    copies = scratch.put(
        timed.where("_copies IS NOT NULL").select(F.explode("_copies").alias("c"), "_size")
        .select("c.*", "_size", F.floor(F.col("c.t") * slots).cast("long").alias("slot")),
    )
    budget = targets.agg(F.max("budget").alias("b")).first().b
    if budget is None:
        return None
    sums = _before(copies.groupBy("slot").agg(F.sum("_size").alias("n")), [], "slot", "n", slots.bit_length()).withColumn("cum", F.col("before") + F.col("n"))
    sums = scratch.put(sums)
    over = sums.where(F.col("cum") > budget).agg(F.min("slot").alias("slot")).first().slot
    done = sums.where(F.col("cum") <= budget).agg(F.max("cum").alias("n"), F.max("slot").alias("slot")).first()
    order = Window.orderBy("t", "r", "p", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = None
    if over is not None:
        inside = copies.where(F.col("slot") == over).withColumn("cum", F.sum("_size").over(order) + F.lit(done.n or 0))
        last = inside.where(F.col("cum") <= budget).orderBy(*(F.desc(x) for x in "trpk")).select("t", "r", "p", "k").first()
    if last is None and done.slot is not None:
        last = copies.where(F.col("slot") == done.slot).orderBy(*(F.desc(x) for x in "trpk")).select("t", "r", "p", "k").first()
    return last


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, one for each copy, in the columns of ``docs``."""
    names = {k: options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    mixed = mix_sources(packed(docs, **{v: F.col(v) for v in names.values()}), **options)
    n = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    kept = mixed.withColumn("_n", n).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return unpacked(kept, docs.columns)
