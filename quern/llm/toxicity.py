"""Toxicity by noisy-channel deobfuscation and word evidence.

All texts give a character trigram model, and labelled ones, for every word, the
number of toxic and clean texts that hold it. Words whose counts speak for toxicity
(by log-likelihood ratio) are evidence, with their log odds as weight.

A word that holds digits, symbols or separators between letters, or letters
three times over, is read as a lattice: each character stands for itself, for
the letters it may replace, or for nothing (separators and repeats), at a cost
each. The Viterbi path under the character model is the restored word. Single
characters set apart by spaces or marks are joined and restored likewise,
with the one-letter words beside them. A long restored word, and a joined one
of any length, is evidence for the words it holds; tokens of more than ``PIECE``
characters are read in overlapping pieces. So is read a word of letters
alone that differs from one of evidence by doubled letters and v for u, unless
a clean labelled text holds it.

A text's score is a logistic function of its evidence, plain and restored, and
of its length. It is fitted to a sample, by hash of the id, of about ``FIT_ROWS``
labelled texts, each measured by the words of the other half of the labels, so
that no text's label speaks for its own words; the words of evidence of the
result use all labels, and the character model all texts. No trigram and no word
of evidence is left out: the model grows with the vocabulary, 16 bytes a
trigram, and comes to the driver in parts of ``PART`` rows.

Up to ``SENT_LABELS`` labels are sent to the texts; more are joined with them,
with the same result.

Cases: null and empty texts score the value for no evidence; unlabelled rows,
labels of absent documents and null labels teach nothing; a row labelled twice
counts twice; of restored words that tie in likelihood the one that comes last
in the alphabet is taken; with no labels at all every score is 0.0; repeated
rows score alike; a very long text is measured whole, in a part of a batch of
its own; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices
from quern.shared import Scratch

FOLDS, HELD_OUT = 5, 0
FIT_ROWS = 20_000
#: Labels up to this number (some 10 MB) are sent to every executor, so that texts needn't be shuffled to them.
SENT_LABELS = 500_000
#: Kinds of counts: words in texts of either half of the labels, and trigrams.
HALVES, TRIGRAMS = (0, 2), 1
PART = 1_000_000
LEAST_TEXTS, LEAST_RATIO = 6, 20.0
FLUSH = 200_000
#: Characters of a token up to which what it tells is kept, and those that are restored at once, with their overlap.
KEPT, PIECE, OVERLAP = 64, 512, 128
#: What a character may stand for besides itself.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "v": "u",
}
DROPPED = set(".,-_*~^'`:;/\\=+#")
REPLACE, DROP, KEEP_ODD = 1.0, 0.5, 8.0
#: Leaving out a letter's second, and each further, repeat.
REPEAT = 3.0, 0.3
STRIPPED = ".,;:!?\"'()[]{}<>*#%&|-_~/\\=`^"
#: Single letters or digits set apart by anything else, however long; not from the end of a contraction.
_SPACED = re.compile(r"(?<![^\W_])(?<![^\W_]['’])[^\W_](?:[\W_]+[^\W_](?![^\W_])){2,}")
_DOUBLED = re.compile(r"([^\W\d_])\1|v")
_REPEATED = re.compile(r"(.)\1+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")


def packed(trigrams: list[str]) -> np.ndarray:
    """Three characters, of 21 bits each, as a number."""
    c = np.array(trigrams, "<U3").view(np.uint32).reshape(-1, 3).astype(np.int64)
    return c[:, 0] << 42 | c[:, 1] << 21 | c[:, 2]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def char_tables(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of packed trigrams, their last two and last characters, and the two and one before the last."""
    two, one = (1 << 42) - 1, (1 << 21) - 1
    return [_summed(k, counts) for k in (keys, keys & two, keys & one, keys >> 21, keys >> 21 & one)]


def _count(table: tuple[np.ndarray, np.ndarray], key: int) -> int:
    keys, counts = table
    i = keys.searchsorted(key)
    return int(counts[i]) if i < len(keys) and keys[i] == key else 0


class CharModel:
    """Character trigrams, smoothed by bigrams and single characters."""

    def __init__(self, trigrams: dict[str, int] | list[tuple[np.ndarray, np.ndarray]]):
        """Counts by trigram, or their ``char_tables``."""
        if isinstance(trigrams, dict):
            trigrams = char_tables(packed(list(trigrams)), np.array(list(trigrams.values()), np.int64))
        self.tri, self.bi, self.uni, self.ctx2, self.ctx1 = trigrams
        self.total = int(self.uni[1].sum()) + 1
        self.seen: dict[str, float] = {}
        self.words: dict[str, str] = {}

    def logp(self, g: str) -> float:
        """Of the last of three characters after the first two."""
        p = self.seen.get(g)
        if p is None:
            a, b, c = map(ord, g)
            one = (_count(self.uni, c) + 0.1) / (self.total + 10)
            two = (_count(self.bi, b << 21 | c) + 2 * one) / (_count(self.ctx1, b) + 2)
            if len(self.seen) > FLUSH:
                self.seen.clear()
            p = self.seen[g] = math.log((_count(self.tri, a << 42 | b << 21 | c) + 2 * two) / (_count(self.ctx2, a << 21 | b) + 2))
        return p

    def restore(self, token: str) -> str:
        """The likeliest plain word behind a lower-case token."""
        known = self.words.get(token)
        if known is not None:
            return known
        paths: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        before, run = "", 0
        for c in token:
            run = run + 1 if c == before else 0
            steps = [(c, 0.0 if c.isalpha() else KEEP_ODD)] + [(x, REPLACE) for x in STANDS_FOR.get(c, "")]
            if c in DROPPED:
                steps.append(("", DROP))
            elif c == before:
                steps.append(("", REPEAT[run > 1]))
            after: dict[str, tuple[float, str]] = {}
            for ctx, (score, out) in paths.items():
                for x, cost in steps:
                    to = ctx[1] + x if x else ctx
                    s = score - cost + (self.logp(ctx + x) if x else 0.0)
                    if to not in after or s > after[to][0]:
                        after[to] = (s, out + x)
            paths, before = after, c
        best = max(paths.items(), key=lambda kv: (kv[1][0] + self.logp(kv[0] + "$"), kv[1][1]))[1][1]
        if len(self.words) > FLUSH:
            self.words.clear()
        if len(token) <= KEPT:
            self.words[token] = best
        return best


def stripped(token: str) -> str:
    """Without the marks around it, and without a mark that ends it three times over."""
    token = token.strip(STRIPPED)
    if len(token) > 2 and token[-1] == token[-2] == token[-3] and not token[-1].isalpha():
        token = token.rstrip(token[-1]).strip(STRIPPED)
    return token


def plain_words(low: str) -> set[str]:
    """Distinct words of letters alone of a lower-case text."""
    tokens = set(low.split())
    plain = {t for t in tokens if t.isalpha()}
    return plain | {t for t in map(stripped, tokens - plain) if t.isalpha()}


def spaced_words(low: str) -> set[str]:
    """The joined runs of single characters of a lower-case text."""
    return {"".join(c for c in m.group() if c.isalnum()) for m in _SPACED.finditer(low)}


def _learned(texts: DataFrame) -> DataFrame:
    """``kind, key, toxic, clean`` of ``texts(text, toxic, clean, half)``: labels of the texts holding each word, and trigrams of words in all texts.

    Of ``texts`` the numbers of labels are null where there are none. A trigram's
    count is its ``clean``.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of: Counter[str] = Counter()
        told: dict[tuple[int, int], Counter[str]] = {(half, y): Counter() for half in (0, 1) for y in (0, 1)}

        def out() -> Iterator[pa.RecordBatch]:
            grams: Counter[str] = Counter()
            for w, n in texts_of.items():
                s = f"^^{w}$"
                for i in range(len(s) - 2):
                    grams[s[i : i + 3]] += n
            parts = [(TRIGRAMS, list(grams), [0] * len(grams), list(grams.values()))]
            for half, kind in enumerate(HALVES):
                clean, toxic = told[half, 0], told[half, 1]
                keys = list(clean.keys() | toxic.keys())
                parts.append((kind, keys, [toxic[k] for k in keys], [clean[k] for k in keys]))
            for kind, keys, toxic, clean in parts:
                yield pa.record_batch([pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["kind", "key", "toxic", "clean"])
            for c in (texts_of, *told.values()):
                c.clear()

        for b in slices(batches, 0):
            for text, toxic, clean, half in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = plain_words((text or "").lower())
                texts_of.update(words)
                if toxic is not None:
                    for y, times in ((1, toxic), (0, clean)):
                        for _ in range(times):
                            told[half, y].update(words)
                if len(texts_of) > FLUSH:
                    yield from out()
        yield from out()

    return texts.mapInArrow(count, "kind int, key string, toxic long, clean long").groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _in_parts(rows: DataFrame, part: int = PART) -> Iterator[pa.Table]:
    """All ``rows(key, ...)`` at the driver, about ``part`` at a time."""
    parts = rows.count() // part + 1
    for i in range(parts):
        yield rows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == i).toArrow()


def _char_tables(learned: DataFrame, part: int = PART) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``char_tables`` of all trigrams."""
    got = [(packed(t.column("key").to_pylist()), t.column("clean").to_numpy()) for t in _in_parts(learned.where(F.col("kind") == TRIGRAMS).select("key", "clean"), part)]
    return char_tables(*(np.concatenate(x) for x in zip(*got, strict=True)))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def _evidence(learned: DataFrame, toxic: int, clean: int, part: int = PART, halves: tuple[int, ...] = HALVES) -> dict[str, float]:
    """Weights of all words that speak for toxicity, by so many labels of some halves."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n = float(toxic + clean)
    c, d = F.lit(float(toxic)) - a, F.lit(float(clean)) - b
    ratio = 2 * (_xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d) - _xlogx(a + b) - _xlogx(c + d) - _xlogx(a + c) - _xlogx(b + d) + n * math.log(n))
    weight = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    words = learned.where(F.col("kind").isin(*halves)).groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = words.where(F.col("toxic") >= LEAST_TEXTS).select("key", ratio.alias("r"), weight.alias("w")).where((F.col("w") > 0) & (F.col("r") >= LEAST_RATIO))
    return {k: w for t in _in_parts(rows.select("key", "w"), part) for k, w in zip(t.column("key").to_pylist(), t.column("w").to_pylist(), strict=True)}


def held_sizes(weights: dict[str, float]) -> list[int]:
    """Sizes of the words to look for inside others."""
    return sorted({len(w) for w in weights if len(w) > 3})


def form(word: str) -> str:
    """Alike for words that differ by doubled letters and v for u."""
    return _REPEATED.sub(r"\1", word.replace("v", "u"))


def _known(learned: DataFrame, weights: dict[str, float], part: int = PART) -> set[str]:
    """Words of clean texts that have the form of a word of evidence, and aren't one."""
    if not weights:
        return set()
    forms = learned.sparkSession.createDataFrame([(f,) for f in sorted({form(w) for w in weights})], "form string")
    words = learned.where((F.col("kind") != TRIGRAMS) & (F.col("clean") > 0)).select("key", F.regexp_replace(F.translate("key", "v", "u"), r"(.)\1+", "$1").alias("form"))
    return {k for t in _in_parts(words.join(forms, "form", "left_semi").select("key").distinct(), part) for k in t.column("key").to_pylist()} - weights.keys()


class Reader:
    """Finds evidence in texts; what a token tells is found once, and kept for the ``FLUSH`` last tokens at most."""

    def __init__(self, weights: dict[str, float], chars: CharModel, known: Set[str] = frozenset()):
        """``known`` are words of the form of one of evidence that stand for themselves."""
        self.weights, self.chars, self.known = weights, chars, known
        self.sizes, self.forms = held_sizes(weights), {form(w) for w in weights}
        self.seen: set[str] = set()
        self.telling: dict[str, frozenset[str]] = {}

    def restored(self, token: str, whole: bool) -> set[str]:
        """Words of evidence that a token stands for, or holds, if that is long or a joined run (not ``whole``)."""
        found: set[str] = set()
        for at in range(0, max(1, len(token) - OVERLAP), PIECE - OVERLAP):
            word = self.chars.restore(token if len(token) <= PIECE else token[at : at + PIECE])
            if word in self.weights:
                found.add(word)
            elif len(word) > 7 or not whole:
                found |= {w for n in self.sizes if n <= len(word) for i in range(len(word) - n + 1) if (w := word[i : i + n]) in self.weights}
            if len(token) <= PIECE:
                break
        return found

    def token(self, token: str) -> set[str]:
        """Words of evidence that a token of a lower-case text tells of."""
        token = stripped(token) if not token.isalpha() else token
        if not token.isalpha():
            return self.restored(token, True) if any(c.isalpha() for c in token) else set()
        hits = {token} & self.weights.keys()
        disguised = not hits and token not in self.known and _DOUBLED.search(token) and form(token) in self.forms
        return hits | (self.restored(token, True) if disguised or _TRIPLE.search(token) else set())

    def evidence(self, text: str) -> float:
        low = text.lower()
        tokens = set(low.split())
        new, hits = tokens - self.seen, set()
        if new:
            if len(self.seen) > FLUSH:
                self.seen, self.telling, new = set(), {}, tokens
            for t in new:
                told = self.token(t)
                if len(t) > KEPT:
                    hits |= told
                elif told:
                    self.telling[t] = frozenset(told)
            self.seen.update(t for t in new if len(t) <= KEPT)
        hits.update(*(self.telling[t] for t in tokens & self.telling.keys()))
        for run in spaced_words(low):
            hits |= self.restored(run, False)
        return math.fsum(self.weights[w] for w in hits)


def _measured(docs: DataFrame, weights: dict[str, float], trigrams: list[tuple[np.ndarray, np.ndarray]], known: set[str]) -> DataFrame:
    """``docs(id, text, ...)`` with ``evidence`` and ``size`` in place of the text."""
    model = docs.sparkSession.sparkContext.broadcast((weights, trigrams, known))
    rest, at = [c for c in docs.columns if c != "text"], docs.columns.index("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value[0], CharModel(model.value[1]), model.value[2])
        for b in slices(batches, at):
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in rest), pa.array([reader.evidence(t) for t in texts], pa.float64()), pa.array([math.log1p(len(t)) for t in texts], pa.float64())], names=[*rest, "evidence", "size"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(measure, f"{kinds}, evidence double, size double")


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of 1, evidence, its root and size, by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 1e-2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def half_of(doc_id: Column, folds: int = FOLDS) -> Column:
    """0 or 1, whatever the fold."""
    return F.pmod(F.floor(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) / folds), F.lit(2)).cast("int")


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_fold: int = HELD_OUT, sent_labels: int = SENT_LABELS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; only labels outside the held-out fold teach."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1)").where(fold_of(F.col("id")) != held_out_fold)
    marks = scratch.put(marks.withColumn("half", half_of(F.col("id"))))
    sent = F.broadcast if marks.count() <= sent_labels else (lambda x: x)
    seen = {(r.half, r.toxic): r.n for r in texts.select("id").join(sent(marks), "id").groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    of = lambda t, halves=(0, 1): sum(seen.get((h, t), 0) for h in halves)
    toxic, clean = of(1), of(0)
    weights, trigrams, known, fit = {}, char_tables(packed([]), np.zeros(0, np.int64)), set(), None
    if toxic and clean:
        told = marks.groupBy("id", "half").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
        learned = scratch.put(_learned(texts.join(sent(told), "id", "left").select("text", "toxic", "clean", "half")))
        weights = _evidence(learned, toxic, clean)
        trigrams, known = _char_tables(learned), _known(learned, weights)
        drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FIT_ROWS / (toxic + clean)))
        picked = scratch.put(marks.where(F.coalesce(drawn, F.lit(True))))
        sample = scratch.put(texts.join(F.broadcast(picked), "id"))  # about FIT_ROWS rows
        rows = []
        for half, other in ((0, 1), (1, 0)):
            own = _evidence(learned, of(1, (other,)), of(0, (other,)), halves=(HALVES[other],)) if of(1, (other,)) and of(0, (other,)) else {}
            rows += _measured(sample.where(F.col("half") == half), own, trigrams, _known(learned, own)).select("evidence", "size", "toxic").collect()
        scratch.drop(learned, sample, picked)
        e, s, y = (np.array([r[i] for r in rows], float) for i in range(3))
        if 0 < y.sum() < len(y):
            fit = _logistic(np.column_stack([np.ones_like(e), e, np.sqrt(e), s]), y)
    scratch.drop(marks)
    z = F.lit(-1e9) if fit is None else F.lit(fit[0]) + F.col("evidence") * fit[1] + F.sqrt("evidence") * fit[2] + F.col("size") * fit[3]
    score = F.when(z > -700, 1 / (1 + F.exp(-z))).otherwise(0.0)
    out = _measured(texts, weights, trigrams, known).withColumn("score", score)
    return out.select(F.col("id").alias("doc_id"), (fold_of(F.col("id")) == held_out_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
