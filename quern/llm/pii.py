"""Personal data: base patterns, and spans added by weak supervision.

Base kinds are found by pattern. Positions come from splitting the text at the
matches, for pieces and matches alternate. Patterns carry look-behinds and
possessive counts, which change no match but keep long texts linear.

Further spans come from candidates: runs of sixteen key characters or more that
hold a digit, and groups of digits split by single separators. Labelers vote on
each, for, against or not at all: the shape of a key or the number of digits
(pattern); whether a word before it, or the issuer's prefix of a key, stands in
the gazetteer, a table that is a parameter; quotes and signs of assignment
around it (context); what its characters repeat; and how they are mixed. What
lies before a candidate is read back to the candidate before it.
Expectation-maximisation estimates from the votes alone how reliable each
labeler is. The posteriors then train a naive Bayes classifier on features of
the span, and spans that it finds more likely than ``ACCEPT`` are added as kind
``secret`` (keys) or ``number`` (digit groups) unless they overlap a base span.

The table of vote and feature patterns has a fixed number of possible rows;
counts are combined before they are shuffled. All of it is DataFrame
operations; only the fitted weights, a row of numbers, pass through the driver.

Cases: a null text has no spans; repeated rows are alike; spans that begin
together are ordered by kind; an empty table, or one without candidates, gives
base spans only; extra columns are ignored, or carried whatever their names;
the work on a very long text grows with its length and its matches, since sums
over matches and cuts of the text run in chunks.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import unpacked, whole
from quern.shared import Scratch

KINDS = ("email", "ip", "card", "phone", "secret", "number")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KEY = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
GROUPS = r"(?<![0-9A-Za-z.+-])[0-9]{2,5}+(?:[\x20.-][0-9]{2,5}+){1,6}+(?![0-9A-Za-z])"
#: Words that announce secrets or personal numbers, and prefixes by which issuers mark their keys.
GAZETTEER = {
    "words": (
        "access", "account", "api", "apikey", "auth", "authorization", "bearer", "call", "card", "cell", "contact", "credential", "credentials", "fax", "iban", "konto", "mail", "mobile", "mobil", "pass", "passport", "passwd",
        "password", "passwort", "phone", "secret", "social", "ssn", "tel", "telefon", "telephone", "token",
    ),
    "prefixes": ("AKIA", "ASIA", "AIza", "eyJ", "ghp_", "gho_", "ghs_", "glpat-", "hf_", "npm_", "pk_", "sk_", "sk-", "xoxb-", "xoxp-", "ya29"),
}
#: How many characters before a candidate the labelers read.
CONTEXT = 24
#: Matches that are summed, and characters that are cut, at once.
CHUNK, CUT = 256, 1024
ACCEPT = 0.5
EM_ROUNDS = 30
LABELERS = 6

NO_SPANS = "array<struct<s:int,k:int,e:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _chunks(items: Column) -> Column:
    """The array cut into arrays of ``CHUNK``; one empty array if there is nothing."""
    last = F.greatest(F.floor((F.size(items) - 1) / CHUNK).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))


def _placed(items: Column) -> Column:
    """``(s, e, m, before)`` of an array of ``(m, gap, n, before)``, by running sums of gaps and lengths.

    Every append copies its array, so sums run within chunks, then over chunks.
    """
    kind = "array<struct<s:int,e:int,m:string,before:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        own = F.struct(start.alias("s"), (start + x["n"]).alias("e"), x["m"].alias("m"), x["before"].alias("before"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    within = lambda chunk: F.aggregate(chunk, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)
    begins = lambda sums: F.aggregate(
        sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"],
    )
    moved = lambda c, b: F.transform(c["out"], lambda x: F.struct((x["s"] + b).alias("s"), (x["e"] + b).alias("e"), x["m"].alias("m"), x["before"].alias("before")))
    return _let(F.transform(_chunks(items), within), lambda sums: F.flatten(F.zip_with(sums, begins(sums), moved)))


def _located(text: Column, pattern: str) -> Column:
    """Array of ``(s, e, m, before)``: where each match starts and ends, in code points, its text and what is before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    paired = F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap"), F.length(m).alias("n"), F.right(p, F.lit(CONTEXT)).alias("before")))
    return _let(F.filter(paired, lambda x: x["m"].isNotNull()), _placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid_ip(m: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\.", -1), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(F.when(F.length(bare(p)) <= 3, bare(p).try_cast("int")), F.lit(0)) <= 255))


def _valid_card(m: Column) -> Column:
    d, n = _digits(m), F.length(_digits(m))

    def doubled(i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), doubled), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(False)


def _spans(text: Column, gate: Column, pattern: str, kind: int, valid=None) -> Column:
    found = _located(text, pattern)
    if valid is not None:
        found = F.filter(found, lambda x: valid(x["m"]))
    spans = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))
    return F.when(gate, spans).otherwise(F.array().cast(NO_SPANS))


def _with_base(df: DataFrame) -> DataFrame:
    """``df(_text)`` with ``_base``, the sorted spans of the base kinds."""
    t = F.col("_text")
    df = df.withColumns({"_digit": t.rlike("[0-9]"), "_at": t.contains("@")})
    each = [
        _spans(t, F.col("_at"), EMAIL, 0), _spans(t, F.col("_digit") & t.contains("."), IP, 1, _valid_ip),
        _spans(t, F.col("_digit"), CARD, 2, _valid_card), _spans(t, F.col("_digit") & t.contains("+"), PHONE, 3, lambda m: F.length(_digits(m)).between(10, 15)),
    ]
    df = df.withColumns({f"_k{i}": e for i, e in enumerate(each)})
    return df.withColumn("_base", F.when(F.col("_digit") | F.col("_at"), F.array_sort(F.concat("_k0", "_k1", "_k2", "_k3"))).otherwise(F.array().cast(NO_SPANS))).drop("_k0", "_k1", "_k2", "_k3")


def _share_bin(part: Column, all_: Column) -> Column:
    return F.floor(part * 4 / all_).cast("int")


def _with_candidates(df: DataFrame, gazetteer: dict[str, tuple[str, ...]]) -> DataFrame:
    """``df`` with ``_cands``: spans, by start, with what labelers and classifier look at."""
    t = F.col("_text")
    words = F.array(*map(F.lit, gazetteer["words"]))

    def seen(kind: int):
        return lambda x: _let(F.struct(x["m"].alias("m"), x["before"].alias("before"), _known(x).alias("known"), x["s"].alias("s"), x["e"].alias("e")), lambda y: looked_at(y, kind))

    def _known(x: Column) -> Column:
        marked = F.lit(False)
        for p in gazetteer["prefixes"]:
            marked = marked | x["m"].startswith(p)
        return marked | F.arrays_overlap(F.split(F.lower(x["before"]), "[^a-z]+", -1), words)

    def looked_at(x: Column, kind: int) -> Column:
        m, before, known = x["m"], x["before"], x["known"]
        n, digits = F.length(m), F.length(_digits(m))
        hexed = m.rlike("^[0-9a-f]{24,}$|^[0-9A-F]{24,}$")
        mixed = m.rlike("[a-z]") & m.rlike("[A-Z]")
        vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
        never = F.lit(False)
        votes = F.array(
            vote(hexed | (mixed & (n >= 20)), n < 20) if kind == 4 else F.lit(0),
            vote(digits.between(9, 15), digits < 7) if kind == 5 else F.lit(0),
            vote(known, never), vote(before.rlike("[=:]\\s?[\"']?$"), before.rlike("[A-Za-z]\\s$") & (F.lit(kind) == 5)),
            vote(never, m.rlike("(.)\\1\\1\\1\\1")), vote(digits.between(n * 0.2, n * 0.8), digits < n * 0.1) if kind == 4 else F.lit(0),
        )
        feats = F.array(
            F.lit(kind), F.least(F.floor(n / 8).cast("int"), F.lit(7)), _share_bin(digits, n), F.when(before.rlike("[\"'=:]$"), 1).otherwise(0), F.when(known, 1).otherwise(0), F.when(hexed, 1).when(mixed, 2).otherwise(0),
        )
        return F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), votes.alias("votes"), feats.alias("feats"))

    both = F.concat(*(F.transform(_located(t, p), seen(k)) for k, p in ((4, KEY), (5, GROUPS))))
    kind = "array<struct<s:int,k:int,e:int,votes:array<int>,feats:array<int>>>"
    return df.withColumn("_cands", F.when(F.col("_digit"), F.array_sort(both)).otherwise(F.array()).cast(kind))


def posteriors(patterns: Column) -> Column:
    """EM over an array of ``(votes, n)``: its elements with ``q``, the probability that such a span is personal.

    A labeler has one chance to vote for a true span and one for a false one,
    where it votes; both have priors worth ten votes that it is right four
    times in five.
    """
    ls = range(LABELERS)

    def belief(state: Column, votes: Column) -> Column:
        odds = F.log(state["pi"] / (1 - state["pi"]))
        for i in ls:
            a, b = state["a"][i], state["b"][i]
            odds = odds + F.when(votes[i] == 1, F.log(a / b)).when(votes[i] == -1, F.log((1 - a) / (1 - b))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def judged(state: Column) -> Column:
        return F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), belief(state, p["votes"]).alias("q")))

    def total(qs: Column, f) -> Column:
        return F.aggregate(qs, F.lit(0.0), lambda acc, x: acc + f(x))

    def chance(qs: Column, i: int, weight, prior: float) -> Column:
        votes = total(qs, lambda x: F.when(x["votes"][i] != 0, weight(x)).otherwise(0.0))
        return (total(qs, lambda x: F.when(x["votes"][i] == 1, weight(x)).otherwise(0.0)) + 10 * prior) / (votes + 10)

    def step(state: Column, _: Column) -> Column:
        true, false = (lambda x: x["n"] * x["q"]), (lambda x: x["n"] * (1 - x["q"]))
        return _let(judged(state), lambda qs: F.struct(
            ((total(qs, true) + 1) / (total(qs, lambda x: x["n"]) + 2)).alias("pi"), F.array(*(chance(qs, i, true, 0.8) for i in ls)).alias("a"), F.array(*(chance(qs, i, false, 0.2) for i in ls)).alias("b"),
        ))

    start = F.struct(F.lit(0.5).alias("pi"), F.array(*(F.lit(0.8) for _ in ls)).alias("a"), F.array(*(F.lit(0.2) for _ in ls)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step, judged)


def fit_spans(scratch: Scratch, cands: DataFrame) -> dict:
    """The classifier's weights from ``cands(_cands)``: ``prior`` and ``(feature, value)`` to log odds."""
    seen = scratch.put(cands.select(F.explode("_cands").alias("c")).groupBy("c.votes", "c.feats").agg(F.count("*").cast("double").alias("n")))
    by_votes = seen.groupBy("votes").agg(F.sum("n").alias("n"))
    judged = by_votes.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p")).select(F.explode(posteriors(F.col("p"))).alias("x")).select("x.votes", "x.q")
    soft = seen.join(judged, "votes").select(F.posexplode("feats").alias("f", "v"), (F.col("n") * F.col("q")).alias("yes"), (F.col("n") * (1 - F.col("q"))).alias("no"))
    sums = soft.groupBy("f", "v").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # a row for each value of each feature
    yes, no = (sum(getattr(r, k) for r in sums if r.f == 0) for k in ("yes", "no"))
    weights = {(r.f, r.v): log((r.yes + 0.5) / (yes + 2)) - log((r.no + 0.5) / (no + 2)) for r in sums}
    return {"prior": log((yes + 1) / (no + 1)), "weights": weights}


def _log_odds(feats: Column, model: dict) -> Column:
    odds = F.lit(float(model["prior"]))
    for f in sorted({f for f, _ in model["weights"]}):
        own = F.lit(0.0)
        for (g, v), w in sorted(model["weights"].items()):
            if g == f:
                own = F.when(feats[f] == v, F.lit(float(w))).otherwise(own)
        odds = odds + own
    return odds


def _apart(cands: Column, base: Column) -> Column:
    """Those of the candidates, which are sorted, that overlap no base span; each chunk looks at the spans near it."""
    def free(chunk: Column) -> Column:
        lo, hi = chunk[0]["s"], F.aggregate(chunk, F.lit(0), lambda acc, c: F.greatest(acc, c["e"]))
        near = F.filter(base, lambda b: (b["s"] < hi) & (b["e"] > lo))
        return _let(near, lambda n: F.filter(chunk, lambda c: ~F.exists(n, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))))

    return F.flatten(F.transform(F.filter(_chunks(cands), lambda c: F.size(c) > 0), free))


def _with_spans(df: DataFrame, model: dict, accept: float) -> DataFrame:
    """``df`` with ``_all``: base spans and those the classifier adds."""
    cut = log(accept / (1 - accept))
    likely = F.filter("_cands", lambda c: _log_odds(c["feats"], model) >= cut)
    added = F.transform(_let(likely, lambda cs: _apart(cs, F.col("_base"))), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    return df.withColumn("_all", F.when(F.size("_cands") > 0, F.array_sort(F.concat("_base", added))).otherwise(F.col("_base")))


def find_personal_data(
    docs: DataFrame, *, accept: float = ACCEPT, gazetteer: dict[str, tuple[str, ...]] = GAZETTEER, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), with_text: bool = False,
) -> DataFrame:
    """``_row`` (``carry``), ``base`` and ``spans``: arrays of ``(s, k, e)``, start, kind (a place in ``KINDS``) and end.

    ``with_text`` adds ``_text``. What was found is then found again after the
    fit rather than stored beside a second copy of the text.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"), whole(text_col).alias("_text"))
    if with_text:
        model = fit_spans(scratch, _with_candidates(rows.select("_text").withColumn("_digit", F.col("_text").rlike("[0-9]")).where("_digit"), gazetteer))
        found = _with_candidates(_with_base(rows), gazetteer)
    else:
        found = scratch.put(_with_candidates(_with_base(rows), gazetteer).select("_row", "_base", "_cands"))
        model = fit_spans(scratch, found)
    return _with_spans(found, model, accept).select("_row", *(["_text"] if with_text else []), F.col("_base").alias("base"), F.col("_all").alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first one's kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    kind = "array<struct<lo:int,hi:int,k:int>>"

    def step(acc: Column, x: Column) -> Column:
        own = F.array(F.struct(acc["at"].alias("lo"), x["s"].alias("hi"), x["k"].alias("k")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def over(acc: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return _let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    kept = F.aggregate(_chunks(spans), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), over)

    def put_together(x: Column) -> Column:
        blocks, found = x["blocks"], x["found"]

        def part(lo: Column, hi: Column) -> Column:
            i = F.floor(lo / CUT).cast("int")
            n = F.greatest(F.floor((hi - 1) / CUT).cast("int") - i, F.lit(0)) + 1
            return F.substring(F.array_join(F.slice(blocks, i + 1, n), ""), lo - i * CUT + 1, hi - lo)

        parts = F.transform(F.flatten(found["out"]), lambda g: F.concat(part(g["lo"], g["hi"]), names[g["k"]]))
        return F.array_join(F.concat(parts, F.array(part(found["at"], F.length(text)))), "")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(F.struct(blocks.alias("blocks"), kept.alias("found")), put_together)).otherwise(text)


def without_personal_data(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with spans replaced; a null text stays null. ``length_col``, where there is one, follows the text."""
    found = find_personal_data(docs, text_col=text_col, carry=tuple(docs.columns), with_text=True, **options)
    text = F.when(F.col(f"_row.`{text_col}`").isNull(), F.lit(None)).otherwise(redacted(F.col("_text"), F.col("spans")))
    found = found.withColumn("_new", text)
    new = {text_col: F.col("_new")} | ({length_col: F.when(F.size("spans") > 0, F.length("_new").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"_row.`{length_col}`"))} if length_col in docs.columns else {})
    return unpacked(found, docs.columns, **new).select(*docs.columns)
