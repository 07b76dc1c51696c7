"""Near-duplicates by an inverted join over the coordinates of min-wise signatures.

1. Texts with the same words in the same order form a class; its smallest id is
   a node, and only nodes go on.
2. A node is posted under each of its signature's coordinate-value pairs
   (tokens), first under ``coordinates - matches + 1`` of them: a node that
   shares none of these can't reach the threshold. Of the rest, tokens that no
   other node has can't collide and are dropped, and with them all nodes that
   are left with fewer tokens than the match threshold.
3. Two nodes that share ``matches`` tokens share one of their rarest
   ``m - matches + 1``, where m is what each has left, so only these prefixes
   are joined; frequent tokens, such as those of a common passage, stay out.
4. A list whose nodes already lie in one component can't add anything and is
   skipped. Two rounds link each node to the leader that most of its lists
   have; then all pairs across components are compared. Lists of up to
   ``short_list`` nodes are joined with themselves. Of a longer one, only the
   nodes outside its largest component go to all of its blocks, where their
   collisions with the block's nodes are counted by merging the shorter posting
   lists and skipping through the longer ones (a node that is in none of the
   ``m - matches + 1`` shortest can't reach the threshold). Blocks are bounded
   by the bytes of their tokens and sets.
5. Pairs with enough matching coordinates are confirmed on their full shingle
   sets, best matches first, unless confirmed links join them already.
   Components of the confirmed links are the groups.

A leader's tokens and sets meet its pairs under ``SALTS`` salts of the other
node, so that no task has all pairs of one leader.

With 128 coordinates and 76 matches a link at similarity 0.75 exactly is missed
with a probability of about 3.5e-5, a link at 0.8 with one of 2.7e-8.

Ids are whole numbers, or texts of such; others become null.

Cases: a text without words has an empty set, belongs to itself and is kept; a
null id takes no part in linking, has no component and is kept; rows that
repeat an id are one document, linked by any of their texts; of nodes that tie
the smallest id leads; a very long text has one row a step, and its set is
held by one task at a time; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.batches import slices
from quern.llm.graph import Merged, components
from quern.llm.shingles import Signer, sequence_values, shingle_sets
from quern.llm.text import packed, unpacked
from quern.shared import Scratch

WORDS = 5
COORDINATES = 128
MATCHES = 76
#: Similarity in hundredths.
SIMILAR = 75
#: Lists up to this length are joined with themselves, longer ones compared in blocks; both find the same links.
SHORT_LIST = 64
#: Bytes of the tokens and sets of a block.
BLOCK = 8 << 20
#: Parts into which the pairs of one leader may fall.
SALTS = 1024


def _signed(docs: DataFrame, id_col: str, text_col: str, words: int, coordinates: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(coordinates)
        for b in slices(batches):
            n, a, c, toks = [], [], [], []
            for own, values in shingle_sets(b.column(1).to_pylist(), words):
                n.append(len(values))
                x, y = sequence_values(own) if len(own) else (0, 0)
                a.append(x)
                c.append(y)
                toks.append(signer.tokens(values) if len(values) else None)
            as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), as_long(a), as_long(c), pa.array(toks, pa.list_(pa.int64()))], names=["id", "n", "h1", "h2", "toks"])

    src = docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(sign, "id long, n long, h1 long, h2 long, toks array<long>")


def _with_sets(docs: DataFrame, words: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h1, values = [], []
            for own, s in shingle_sets(b.column(1).to_pylist(), words):
                h1.append(sequence_values(own)[0] if len(own) else 0)
                values.append(s.view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(values, pa.list_(pa.int64()))], names=["id", "h1", "values"])

    return docs.mapInArrow(sets, "id long, h1 long, values array<long>")


def _may_match(nodes: DataFrame, matches: int, coordinates: int) -> DataFrame:
    """Those of ``nodes(node, n, toks)`` that share one of the first ``coordinates - matches + 1`` tokens with another.

    Two nodes with ``matches`` equal coordinates can't differ in all of these.
    """
    first = nodes.select("node", F.explode(F.slice("toks", 1, coordinates - matches + 1)).alias("tok"))
    shared = first.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    return nodes.join(first.join(shared, "tok").select("node").distinct(), "node", "left_semi")


def _candidates(nodes: DataFrame, matches: int) -> DataFrame:
    """``node, n, toks, prefix`` of the nodes that may have a partner; ``toks`` are those that some other node has."""
    posted = nodes.select("node", F.explode("toks").alias("tok"))
    shared = posted.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    left = posted.join(shared, "tok").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("own")).where(F.size("own") >= matches)
    prefix = F.slice("own", F.lit(1), F.size("own") - matches + 1)
    return left.join(nodes.select("node", "n"), "node").select("node", "n", F.col("own.tok").alias("toks"), prefix["tok"].alias("prefix"))


def _beside(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """``pairs(u, v)`` with ``a`` and ``b``, the ``value`` of each side's row in ``rows(node, ...)``; v may be a hub."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
    needed = salted.select("v", "salt").distinct().join(rows.select(F.col("node").alias("v"), F.col(value).alias("b")), "v")
    return salted.join(rows.select(F.col("node").alias("u"), F.col(value).alias("a")), "u").join(needed, ["v", "salt"]).drop("salt")


def _matched(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """Those ``pairs(u, v)`` with enough equal coordinates, and their number ``m``."""
    return _beside(pairs, nodes, "toks").select("u", "v", F.size(F.array_intersect("a", "b")).alias("m")).where(F.col("m") >= matches)


def _similar(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Those ``pairs(u, v)`` whose full sets are similar enough."""
    both = _beside(pairs, sets, "values")
    x, y = F.size("a"), F.size("b")
    near = F.when(F.least(x, y) * 100 >= F.greatest(x, y) * similar, F.size(F.array_intersect("a", "b")) * (100 + similar) >= (x + y) * similar)
    return both.where(near).select("u", "v")


def _with_components(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``lists(tok, node, n)`` with each node's component, without the lists that lie in one.

    ``len`` is the list's length, ``main`` its largest component, ``size`` and
    ``outside`` the bytes of all its nodes and of those outside that.
    """
    own = lists.withColumn("comp", F.col("node")) if labels is None else lists.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    parts = own.groupBy("tok", "comp").agg(F.count("*").alias("k"), F.sum(F.col("n") * 8 + COORDINATES * 8).alias("bytes"))
    whole = parts.groupBy("tok").agg(F.sum("k").alias("len"), F.count("*").alias("kinds"), F.max(F.struct("k", "comp", "bytes")).alias("x"), F.sum("bytes").alias("size")).where("kinds > 1")
    return own.join(whole.select("tok", "len", F.col("x.comp").alias("main"), "size", (F.col("size") - F.col("x.bytes")).alias("outside")), "tok")


def _best_leaders(lists: DataFrame, round_: int) -> DataFrame:
    """One pair a node: of its lists' leaders in other components, the one that most of its lists have."""
    rank = F.col("node") if round_ == 0 else F.xxhash64("node", F.lit(round_))
    leaders = lists.groupBy("tok").agg(F.min(F.struct(rank.alias("rank"), F.col("node").alias("leader"), F.col("comp").alias("lcomp"))).alias("x")).select("tok", "x.leader", "x.lcomp")
    pairs = lists.join(leaders, "tok").where("comp <> lcomp").groupBy(F.col("node").alias("u"), F.col("leader").alias("v")).agg(F.count("*").alias("k"))
    return pairs.groupBy("u").agg(F.max(F.struct("k", "v")).alias("x")).select("u", F.col("x.v").alias("v"))


def _short_list_pairs(lists: DataFrame, short_list: int) -> DataFrame:
    a = lists.where(F.col("len") <= short_list).select("tok", "node", "comp")
    b = a.select("tok", F.col("node").alias("v"), F.col("comp").alias("vcomp"))
    return a.join(b, "tok").where("node < v AND comp <> vcomp").select(F.col("node").alias("u"), "v").distinct()


def _dealt(lists: DataFrame, short_list: int, block: int) -> DataFrame:
    """``tok, i, j, visits, node, comp, main`` of the long lists' nodes for every pair of blocks that they are in.

    Each node lies in one block ``i`` of its list. Nodes outside the main
    component also lie in one block ``j`` of visitors, which goes to all ``i``.
    """
    long_ = lists.where(F.col("len") > short_list).withColumns({"own": F.ceil(F.col("size") / block).cast("int"), "guests": F.ceil(F.col("outside") / block).cast("int")})
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    stay = long_.select("tok", at("own", 0).alias("i"), upto("guests").alias("j"), F.lit(False).alias("visits"), "node", "comp", "main")
    go = long_.where("comp <> main").select("tok", upto("own").alias("i"), at("guests", 1).alias("j"), F.lit(True).alias("visits"), "node", "comp", "main")
    return stay.union(go)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins, and one array of all their values."""
    one = lists.combine_chunks()
    return np.concatenate([[0], np.cumsum(one.value_lengths().to_numpy())]).astype(np.int64), one.flatten().to_numpy()


class Postings:
    """Posting lists of a block: for each token the sorted rows that have it."""

    def __init__(self, begins: np.ndarray, tokens: np.ndarray):
        rows = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        order = np.argsort(tokens, kind="stable")
        self.rows = rows[order]
        self.tokens, self.first = np.unique(tokens[order], return_index=True)
        self.last = np.append(self.first[1:], len(tokens))

    def matching(self, tokens: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have at least ``matches`` of some distinct tokens, and how many.

        The shortest lists are merged; the others, of which there are fewer
        than ``matches``, are only searched for the rows found there, and a
        row is left as soon as it can't reach the threshold any more.
        """
        at = np.minimum(self.tokens.searchsorted(tokens), max(0, len(self.tokens) - 1))
        at = at[self.tokens[at] == tokens] if len(self.tokens) else at[:0]
        at = at[np.argsort(self.last[at] - self.first[at], kind="stable")]
        merged = max(0, len(at) - matches + 1)
        if not merged:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, counts = np.unique(np.concatenate([self.rows[self.first[t] : self.last[t]] for t in at[:merged]]), return_counts=True)
        for left, t in zip(range(len(at) - merged, 0, -1), at[merged:], strict=True):
            may = counts + left >= matches
            if not may.all():
                found, counts = found[may], counts[may]
                if not len(found):
                    break
            own = self.rows[self.first[t] : self.last[t]]
            counts = counts + (own[np.minimum(own.searchsorted(found), len(own) - 1)] == found)
        enough = counts >= matches
        return found[enough], counts[enough]


def _long_list_links(lists: DataFrame, sets: DataFrame, matches: int, similar: int, short_list: int, block: int) -> DataFrame:
    """Confirmed links between components within lists too long to join.

    A task has a block of a list's nodes and one of its visitors, and returns
    only links that join components it hasn't joined yet.
    """
    keyed = _dealt(lists, short_list, block).join(sets.select("node", "toks", "values"), "node")

    def compare(table: pa.Table) -> pa.Table:
        visits = table.column("visits").to_numpy()
        here, guests = table.filter(pa.array(~visits)), table.filter(pa.array(visits))
        node, comp = (here.column(c).to_numpy() for c in ("node", "comp"))
        outside = comp != here.column("main").to_numpy() if len(node) else np.zeros(0, bool)
        postings = Postings(*_flat(here.column("toks")))
        (begins, tokens), (bounds, values), (own_bounds, own_values) = _flat(guests.column("toks")), _flat(here.column("values")), _flat(guests.column("values"))
        merged, found, sets_ = Merged(), [], {}

        def full(y: int) -> frozenset:
            if y not in sets_:
                sets_[y] = frozenset(values[bounds[y] : bounds[y + 1]].tolist())
            return sets_[y]

        for i, (u, c) in enumerate(zip(guests.column("node").to_pylist(), guests.column("comp").to_pylist(), strict=True)):
            rows, equal = postings.matching(tokens[begins[i] : begins[i + 1]], matches)
            # two nodes outside the main component meet twice, once in either's block
            other = (comp[rows] != c) & (~outside[rows] | (node[rows] > u))
            rows, equal, own = rows[other], equal[other], None
            for y in rows[np.argsort(-equal, kind="stable")].tolist():
                if merged.find(c) == merged.find(int(comp[y])):
                    continue
                own = frozenset(own_values[own_bounds[i] : own_bounds[i + 1]].tolist()) if own is None else own
                b = full(y)
                if min(len(own), len(b)) * 100 >= max(len(own), len(b)) * similar and len(own & b) * (100 + similar) >= similar * (len(own) + len(b)):
                    merged.join(c, int(comp[y]))
                    found.append((u, int(node[y])))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return keyed.groupBy("tok", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, *, words: int = WORDS, coordinates: int = COORDINATES, matches: int = MATCHES, similar: int = SIMILAR, short_list: int = SHORT_LIST, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    signed = scratch.put(_signed(docs, id_col, text_col, words, coordinates))
    linkable = signed.where("id IS NOT NULL AND n > 0")
    classes = scratch.put(linkable.groupBy("h1", "h2").agg(F.min("id").alias("node")))
    nodes = scratch.put(linkable.join(classes, ["h1", "h2"]).where("id = node").groupBy("h1", "h2", "node").agg(F.first("n").alias("n"), F.first("toks").alias("toks")))
    wide, signed = signed, scratch.put(signed.drop("toks"))
    scratch.drop(wide)
    scratch.release()
    linkable = signed.where("id IS NOT NULL AND n > 0")
    near = scratch.put(_may_match(nodes, matches, coordinates))
    scratch.drop(nodes)
    scratch.release()
    cands = scratch.put(_candidates(near, matches))
    scratch.drop(near)
    scratch.release()
    sets = _sets(scratch, docs, cands, id_col, text_col, words)
    lists = scratch.put(cands.select("node", "n", F.explode("prefix").alias("tok")).distinct())

    again = linkable.join(classes, ["h1", "h2"]).groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("hi"), F.collect_set("node").alias("all")).where("u < hi")
    links = scratch.put(again.select("u", F.explode("all").alias("v")).where("u <> v"))
    labels = components(links, scratch) if links.take(1) else None
    for round_ in range(2):
        open_ = scratch.put(_with_components(lists, labels))
        found = scratch.put(_similar(_best_leaders(open_, round_), sets, similar))
        links = links.union(found)
        labels = components(links, scratch)
        scratch.drop(open_)
        scratch.release()
    open_ = scratch.put(_with_components(lists, labels))
    links = links.union(scratch.put(_long_list_links(open_, sets, matches, similar, short_list, block)))
    links = links.union(scratch.put(_similar(_matched(_short_list_pairs(open_, short_list), sets, matches).select("u", "v"), sets, similar)))
    labels = components(links, scratch)
    scratch.drop(sets, open_)
    scratch.release()

    of_class = scratch.put(classes.join(labels, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("class_component")))
    scratch.drop_all_but(signed, of_class)
    out = signed.select("id", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    comp = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("class_component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(scratch: Scratch, docs: DataFrame, cands: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node, toks, values`` of the candidates: their texts are read again, so that sets of the rest are never stored."""
    wanted = cands.select(F.col("node").alias("id"))
    texts = docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    found = _with_sets(texts, words).join(cands.select(F.col("node").alias("id"), "toks"), "id")
    return scratch.put(found.groupBy(F.col("id").alias("node"), "h1").agg(F.first("toks").alias("toks"), F.first("values").alias("values")))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, once; rows without an id all stay."""
    id_col = options.get("id_col", "doc_id")
    found = near_duplicates(docs, **options)
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    rows = packed(docs, _id=F.col(id_col).try_cast("long"))
    once = Window.partitionBy("_id").orderBy(F.xxhash64("_row"))
    first = rows.join(kept, "_id", "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return unpacked(first.select("_row"), docs.columns).union(unpacked(rows.where("_id IS NULL"), docs.columns))
