"""Quality rules and robust multivariate outliers.

``text_statistics`` counts words, symbols, repeated lines and repeated
three-word windows. Documents that pass the base rules become vectors of
transformed statistics. For each language and source the subset of a ``SUPPORT``
share of documents whose covariance has the minimum determinant is searched:

1. Three estimates start the search: medians with quartile ranges, mean and
   covariance of all, and the covariance of tanh scores around the medians.
2. A concentration step takes mean and covariance of the ``SUPPORT`` share with
   the least Mahalanobis distance; it doesn't raise the determinant. After
   ``TRIAL_STEPS`` steps each group goes on with the start of least determinant.
3. Steps follow until no group's log-determinant falls by more than
   ``TOLERANCE`` (at most ``MOST_STEPS``).
4. Distances are scaled so that their median is the chi-square one, and mean and
   covariance are taken again of all documents within ``REWEIGHTED``.

Documents beyond ``CUT`` of the last estimate are rejected. ``FLOORS`` are added
to the variances (the determinant is that of the regularised covariance), since
most documents have no symbols or repeats at all.

Every step is one grouped histogram of distances and one grouped sum, combined
before they are shuffled; only rows by group are joined back. Distances are
ranked by the logarithm, in ``DISTANCE_BINS`` bins a unit.

Groups with fewer than ``least`` documents are taken together by language, and
languages with fewer still all together; below ``least`` nothing is rejected by
distance, for so few documents determine no covariance.

Cases: a null text has no words and fails the base rules; null language or
source is a value of its own; repeated rows count each; distances that tie are
taken together; a very long text is one row like any other, its windows held as
hashes; an empty table gives an empty result; result columns win over input
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import SPACE, packed, unpacked, whole
from quern.shared import Scratch

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
#: Documents of a group that the estimate rests on.
SUPPORT = 0.75
STARTS, TRIAL_STEPS, MOST_STEPS, TOLERANCE = 3, 2, 25, 1e-3
LEAST = 50
#: Chi-square quantiles of five degrees of freedom: the median, 97.5 % (for the last estimate) and 99.99 % (for the verdict).
CHI2_MEDIAN, REWEIGHTED, CUT = 4.3515, 12.8325, 25.7448
#: What the covariance of a normal sample falls short by when it is cut at ``REWEIGHTED``.
SHORTFALL = 1.0556
#: Variance added to tanh scores.
SCORE_FLOOR = 0.05
#: Standard deviations added to each of the transformed statistics.
FLOORS = (0.06, 0.35, 0.4, 0.5, 0.2)
DIMS = len(FLOORS)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bins of the logarithm of a distance, and of a transformed statistic, a unit.
DISTANCE_BINS, VALUE_BINS = 256, 100


def with_statistics(df: DataFrame, text: str = "_text") -> DataFrame:
    """``df`` with the base statistics as columns ``_n_words`` ... and two more counts.

    A window of three words is compared by its 64-bit hash, within its document.
    ``_row_no`` is there for filters to refer to: they then stay above these
    expressions, which they would otherwise repeat.
    """
    words = F.array_remove(F.split(F.col(text), SPACE, -1), "")
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_words")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumns({"_words": words, "_lines": lines})
    df = df.withColumns({
        "_n_words": n.cast("long"), "_word_chars": F.length(F.array_join("_words", "")).cast("long"), "_n_lines": F.size("_lines").cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"), "_n_loud": F.regexp_count(text, F.lit("[A-Z!]")).cast("long"),
        "_windows": F.when(n >= 3, window),
    }).drop("_words", "_lines")
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    same = lambda x, j: F.coalesce(F.get("_sorted", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", j + 1)["h"] == x["h"], F.lit(False))
    covered = F.array_distinct(F.flatten(F.transform(F.filter("_sorted", same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return df.withColumns({"_n_repeat_words": F.coalesce(F.size(covered), F.lit(0)).cast("long"), "_row_no": F.monotonically_increasing_id()}).drop("_sorted")


def vector() -> list[Column]:
    """Mean word length, shares of symbols, loud characters, repeated lines and repeated words, on scales near normal."""
    share = lambda part, all_, times, of: F.log(1 + F.col(part) * times / (F.col(all_) + of))  # noqa: E731  0 for none, however long the text
    return [
        F.log((F.col("_word_chars") + 1) / (F.col("_n_words") + 1)), share("_n_symbols", "_word_chars", 400, 150), share("_n_loud", "_word_chars", 400, 150),
        share("_n_dup_lines", "_n_lines", 10, 8), F.asin(F.sqrt(F.least(F.lit(1.0), F.col("_n_repeat_words") / (F.col("_n_words") + 1)))),
    ]


def _groups(scratch: Scratch, docs: DataFrame, least: int) -> DataFrame:
    """``_lang, _source, g``: the name of the group whose estimate applies, null where there are too few documents."""
    n, none = F.col("n"), F.lit(None).cast("string")
    counts = scratch.put(docs.groupBy("_lang", "_source").agg(F.sum(F.when(F.col("ok"), 1).otherwise(0)).alias("n")))
    few = counts.where(n < least).groupBy(F.col("_lang").alias("l")).agg(F.sum("n").alias("few"))
    scarce = few.agg(F.coalesce(F.sum(F.when(F.col("few") < least, F.col("few"))), F.lit(0)).alias("scarce"))  # one row
    name = lambda *x: F.to_json(F.array(*x), {"ignoreNullFields": "false"})
    g = F.when(n >= least, name("_lang", "_source", F.lit("own"))).when(F.col("few") >= least, name("_lang", none, F.lit("language"))).when(F.col("scarce") >= least, name(none, none, F.lit("all")))
    found = counts.join(few, F.col("_lang").eqNullSafe(F.col("l")), "left").crossJoin(F.broadcast(scarce))
    return scratch.put(found.select("_lang", "_source", g.alias("g")))


def _quantile_bins(binned: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """For each key the least bin at which the share of rows reaches each quantile."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumns({"cum": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("cum") >= F.ceil(F.col("all") * q), F.col("bin"))).alias(k) for k, q in quantiles.items()))


def _tri(i: int, j: int) -> int:
    return i * (i + 1) // 2 + j


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, m0 ..., c0_0 ...``: means and covariances of the columns ``x0 ...``."""
    x = [F.col(f"x{i}") for i in range(DIMS)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(x[i]).alias(f"a{i}") for i in range(DIMS)), *(F.sum(x[i] * x[j]).alias(f"b{i}_{j}") for i, j in PAIRS))
    mean = [F.col(f"a{i}") / F.col("n") for i in range(DIMS)]
    return sums.select(*keys, *(mean[i].alias(f"m{i}") for i in range(DIMS)), *((F.col(f"b{i}_{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}_{j}") for i, j in PAIRS))


def _factored(t: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, logdet, mu, w`` of ``t(keys, m0 ..., c0_0 ...)``: ``w`` is the inverse of the Cholesky factor of the covariance."""
    # each factor's entry is a column of its own, for an expression that inlines all of them would grow exponentially
    dot = lambda terms: sum(terms, F.lit(0.0))
    for i in range(DIMS):
        for j in range(i):
            t = t.withColumn(f"l{i}_{j}", (F.col(f"c{i}_{j}") - dot(F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j))) / F.col(f"l{j}_{j}"))
        t = t.withColumn(f"l{i}_{i}", F.sqrt(F.greatest(F.col(f"c{i}_{i}") - dot(F.col(f"l{i}_{k}") * F.col(f"l{i}_{k}") for k in range(i)), F.lit(1e-9))))
    for i in range(DIMS):
        t = t.withColumn(f"w{i}_{i}", 1 / F.col(f"l{i}_{i}"))
        for j in range(i):
            t = t.withColumn(f"w{i}_{j}", -dot(F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)) / F.col(f"l{i}_{i}"))
    logdet = dot(2 * F.log(f"l{i}_{i}") for i in range(DIMS))
    return t.select(*keys, logdet.alias("logdet"), F.array(*(F.col(f"m{i}") for i in range(DIMS))).alias("mu"), F.array(*(F.col(f"w{i}_{j}") for i, j in PAIRS)).alias("w"))


def _estimate(kept: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, logdet, mu, w`` of the kept vectors, by their mean and covariance with ``FLOORS``."""
    t = _moments(kept, keys)
    return _factored(t.withColumns({f"c{i}_{i}": F.col(f"c{i}_{i}") + FLOORS[i] ** 2 for i in range(DIMS)}), keys)


def _starts(scratch: Scratch, vectors: DataFrame) -> DataFrame:
    """``g, start, logdet, mu, w`` of the three estimates that begin the search."""
    each = vectors.select("g", F.posexplode(F.array(*(F.col(f"x{i}") for i in range(DIMS)))).alias("d", "x")).select("g", "d", F.floor(F.col("x") * VALUE_BINS).cast("long").alias("bin"))
    q = _quantile_bins(each, ["g", "d"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    median = [F.max(F.when(F.col("d") == i, (F.col("q2") + 0.5) / VALUE_BINS)).alias(f"m{i}") for i in range(DIMS)]
    spread = [F.max(F.when(F.col("d") == i, F.sqrt(F.pow((F.col("q3") - F.col("q1")) / VALUE_BINS / 1.349, 2) + FLOORS[i] ** 2))).alias(f"s{i}") for i in range(DIMS)]
    by = scratch.put(q.groupBy("g").agg(*median, *spread))
    scored = vectors.join(by, "g").select("g", *(F.tanh((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"x{i}") for i in range(DIMS)))
    scores = _moments(scored, ["g"]).drop(*(f"m{i}" for i in range(DIMS))).join(by, "g")
    middle = [F.col(f"m{i}") for i in range(DIMS)]
    diagonal = by.select("g", *middle, *((F.pow(f"s{i}", F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in PAIRS))
    tanh = scores.select("g", *middle, *(((F.col(f"c{i}_{j}") + (SCORE_FLOOR if i == j else 0.0)) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}_{j}") for i, j in PAIRS))
    found = [_factored(diagonal, ["g"]), _estimate(vectors, ["g"]), _factored(tanh, ["g"])]
    found = [e.select("g", F.lit(i).alias("start"), "logdet", "mu", "w") for i, e in enumerate(found)]
    return scratch.put(found[0].union(found[1]).union(found[2]))


def distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance under ``mu`` and ``w``."""
    d = [x[i] - F.col("mu")[i] for i in range(DIMS)]
    z = [sum((F.col("w")[_tri(i, j)] * d[j] for j in range(i + 1)), F.lit(0.0)) for i in range(DIMS)]
    return sum((a * a for a in z), F.lit(0.0))


def _binned(vectors: DataFrame, est: DataFrame) -> DataFrame:
    far = vectors.join(est.select("g", "start", "mu", "w"), "g").withColumn("d2", distance([F.col(f"x{i}") for i in range(DIMS)]))
    return far.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * DISTANCE_BINS).cast("long"))


def _concentrated(scratch: Scratch, vectors: DataFrame, est: DataFrame) -> DataFrame:
    """One step: the estimates of those ``SUPPORT`` of each group's vectors that are nearest."""
    keys = ["g", "start"]
    far = _binned(vectors, est)
    near = scratch.put(_quantile_bins(far.select(*keys, "bin"), keys, {"top": SUPPORT}))
    return scratch.put(_estimate(far.join(near, keys).where("bin <= top").select(*keys, *(f"x{i}" for i in range(DIMS))), keys))


def _least(*ests: DataFrame) -> DataFrame:
    """For each group the estimate with the least determinant."""
    every = ests[0]
    for e in ests[1:]:
        every = every.union(e)
    return every.groupBy("g").agg(F.min(F.struct("logdet", "start", "mu", "w")).alias("x")).select("g", "x.start", "x.logdet", "x.mu", "x.w")


def minimum_determinants(scratch: Scratch, vectors: DataFrame) -> DataFrame:
    """``g, start, logdet, mu, w``: the estimate of least determinant that the search finds for each group of ``vectors(g, x0, ...)``."""
    est = _starts(scratch, vectors)
    for _ in range(TRIAL_STEPS):
        est = _concentrated(scratch, vectors, est)
    est = scratch.put(_least(est))
    for _ in range(MOST_STEPS):
        after = scratch.put(_least(est, _concentrated(scratch, vectors, est)))
        gain = est.join(after.select("g", F.col("logdet").alias("new")), "g").agg(F.max(F.col("logdet") - F.col("new")).alias("x")).first().x
        est = after
        if gain is None or gain <= TOLERANCE:
            break
    return est


def estimates(scratch: Scratch, vectors: DataFrame) -> DataFrame:
    """``g, mu, w, scale`` of ``vectors(g, x0, ...)``, reweighted."""
    est = minimum_determinants(scratch, vectors)
    far = _binned(vectors, est)
    half = scratch.put(_quantile_bins(far.select("g", "bin"), ["g"], {"half": 0.5}))
    scale = F.exp((F.col("half") + 0.5) / DISTANCE_BINS) / CHI2_MEDIAN
    inside = far.join(half, "g").where(F.col("d2") <= scale * REWEIGHTED).select("g", *(f"x{i}" for i in range(DIMS)))
    return scratch.put(_estimate(inside, ["g"]).select("g", "mu", "w", F.lit(SHORTFALL).alias("scale")))


def assess_quality(
    docs: DataFrame, *, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, cut: float = CUT, least: int = LEAST,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = True, id_col: str = "doc_id",
) -> DataFrame:
    """The statistics of every row with ``base_failed`` and ``kept``, beside all columns of ``docs`` or only the id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    columns = docs.columns if carry else [id_col]
    parts = {"_text": whole(text_col), "_lang": F.col(lang_col), "_source": F.col(source_col)}
    failed = (F.col("_n_words") < min_words) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * max_repeat_percent)
    measured = lambda rows: with_statistics(rows).drop("_text").withColumn("ok", ~failed)
    known = scratch.put(measured(docs.select(F.struct(F.lit(True) if carry else F.col(id_col)).alias("_row"), *(e.alias(k) for k, e in parts.items()))))
    groups = _groups(scratch, known, least)
    same = [F.col("d._lang").eqNullSafe(F.col("k._lang")), F.col("d._source").eqNullSafe(F.col("k._source"))]
    named = lambda rows: rows.alias("d").join(groups.alias("k"), same, "left").select("d.*", "k.g")
    x = vector()
    vectors = scratch.put(named(known).where("ok AND g IS NOT NULL").select("g", *(e.alias(f"x{i}") for i, e in enumerate(x))))
    rated = estimates(scratch, vectors)
    # texts are measured again for a result that carries them, rather than stored a second time
    rows = measured(packed(docs, **parts)) if carry else known
    scratch.drop_all_but(groups, rated, *([] if carry else [known]))
    found = named(rows).join(rated, "g", "left").withColumn("_d2", distance(x) / F.col("scale"))
    stats = {s: F.col(f"_{s}") for s in STATS}
    return unpacked(found, columns, **stats, base_failed=~F.col("ok"), kept=F.col("ok") & (F.col("_row_no") >= 0) & F.coalesce(F.col("_d2") <= cut, F.lit(True)), outlier_distance=F.col("_d2"))


def well_formed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    names = {k: options.get(k, v) for k, v in (("text_col", "text"), ("lang_col", "lang"), ("source_col", "source"))}
    return unpacked(assess_quality(packed(docs, **{v: F.col(v) for v in names.values()}), **options).where("kept"), docs.columns)
