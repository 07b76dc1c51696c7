"""Approximate nearest neighbours by proximity graphs, one for each shard of the vectors.

``build`` deals the vectors into shards of about ``shard_rows`` by hash and
links every vector with the ``m`` nearest of its shard, both ways. ``search``
takes a stated set of queries to all shards: from a few entries it follows links
to ever nearer vectors and keeps the ``ef`` best seen, until none of these has a
link left that was not followed. The best of all shards meet in a window.

A graph is a table, ``shard, id, insert_order, embedding, links``: store it, and
build a shard again to take in new vectors. Memory of a task is a shard, or a
shard and a block of queries; no side is broadcast.

Cases: vectors whose length isn't that of most in their shard take no part, and
a query of another length finds nothing; among equal distances the newer vector
comes first; a shard smaller than ``m`` is linked completely; empty tables give
empty results.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.shared import ship

SHARD_ROWS = 20_000
M, EF, ENTRIES = 8, 32, 4
#: Queries of a block, and rows whose distances are taken at once.
QUERY_BLOCK, STEP = 5_000, 256


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and their places; those of another length than most are left out, and nulls."""
    rows = column.to_pylist()
    sizes = [len(r) if r is not None else -1 for r in rows]
    known = [n for n in sizes if n > 0]
    if not known:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    most = max(sorted(set(known)), key=known.count)
    at = [i for i, n in enumerate(sizes) if n == most]
    return np.array([rows[i] for i in at], np.float64), np.array(at, np.int64)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row to a vector."""
    return np.sqrt(np.square(x - q).sum(axis=1))


def _linked(x: np.ndarray, m: int) -> list[list[int]]:
    """For each row its m nearest others, and the rows that it is one of the m nearest of."""
    n = len(x)
    m = min(m, n - 1)
    out: list[set[int]] = [set() for _ in range(n)]
    squares = np.square(x).sum(axis=1)
    for lo in range(0, n if m > 0 else 0, STEP):
        d = squares[None, :] - 2 * x[lo : lo + STEP] @ x.T
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        for i, near in enumerate(np.argpartition(d, m - 1, axis=1)[:, :m].tolist(), lo):
            out[i].update(near)
            for j in near:
                out[j].add(i)
    return [sorted(s) for s in out]


def build(vectors: DataFrame, *, m: int = M, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``shard, id, insert_order, embedding, links`` of ``vectors(id, insert_order, embedding)``; links are ids."""
    ship(vectors.sparkSession)
    shards = max(1, ceil(vectors.count() / shard_rows))
    id_type = vectors.schema["id"].dataType.simpleString()

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by([("insert_order", "ascending")])
        x, at = matrix(t.column("embedding"))
        t = t.take(at)
        ids = t.column("id").to_pylist()
        links = [[ids[j] for j in row] for row in _linked(x, m)]
        return t.append_column("links", pa.array(links, pa.list_(t.schema.field("id").type)))

    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", F.col("insert_order").cast("long").alias("insert_order"), F.col("embedding").cast("array<double>").alias("embedding"))
    return dealt.groupBy("shard").applyInArrow(link, f"shard int, id {id_type}, insert_order long, embedding array<double>, links array<{id_type}>")


def walk(x: np.ndarray, links: list[list[int]], q: np.ndarray, k: int, ef: int) -> tuple[list[tuple[float, int]], int]:
    """The k nearest rows found from a few entries, as distance and row, and how many rows were looked at."""
    entries = np.unique(np.linspace(0, len(x) - 1, min(ENTRIES, len(x))).astype(int)).tolist()
    seen = set(entries)
    open_ = [(d, i) for d, i in zip(distances(x[entries], q).tolist(), entries, strict=True)]
    heapq.heapify(open_)
    best = [(-d, i) for d, i in open_]
    heapq.heapify(best)
    while open_:
        d, i = heapq.heappop(open_)
        if len(best) >= ef and d > -best[0][0]:
            break
        new = [j for j in links[i] if j not in seen]
        seen.update(new)
        for e, j in zip(distances(x[new], q).tolist(), new, strict=True) if new else ():
            if len(best) < ef or e < -best[0][0]:
                heapq.heappush(open_, (e, j))
                heapq.heappush(best, (-e, j))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted((-d, -i) for d, i in best)[:k], len(seen)


def search(graph: DataFrame, queries: DataFrame, k: int, *, ef: int = EF) -> DataFrame:
    """``query, id, dist, rank, looked_at`` of the k nearest to each of ``queries(query, q)``.

    ``looked_at`` is the number of vectors whose distance was taken in the
    neighbour's shard.
    """
    ship(graph.sparkSession)
    blocks = max(1, ceil(queries.count() / QUERY_BLOCK))
    id_type, query_type = graph.schema["id"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    keep = max(k, ef)

    def find(own: pa.Table, asked: pa.Table) -> pa.Table:
        own = own.sort_by([("insert_order", "ascending")])
        ids, order = own.column("id").to_pylist(), own.column("insert_order").to_pylist()
        place = {v: i for i, v in enumerate(ids)}
        x = np.array(own.column("embedding").to_pylist(), np.float64)
        links = [[place[v] for v in row] for row in own.column("links").to_pylist()]
        rows = []
        for name, q in zip(asked.column("query").to_pylist(), asked.column("q").to_pylist(), strict=True):
            if len(x) and q is not None and len(q) == x.shape[1]:
                found, looked = walk(x, links, np.array(q, np.float64), k, keep)
                rows += [(name, ids[-i], order[-i], d, looked) for d, i in found]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (asked.schema.field("query").type, own.schema.field("id").type, pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query", "id", "insert_order", "dist", "looked_at"])

    left = graph.select(*(F.col(c).alias(c) for c in graph.columns)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shards = graph.groupBy(F.col("shard").alias("shard")).agg(F.count("*").alias("_n")).drop("_n")  # few: a row for each shard
    right = queries.select("query", F.col("q").cast("array<double>").alias("q")).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).crossJoin(shards)
    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(find, f"query {query_type}, id {id_type}, insert_order long, dist double, looked_at long")
    w = Window.partitionBy("query").orderBy("dist", F.desc("insert_order"))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "dist", "rank", "looked_at")


def stats(graph: DataFrame) -> DataFrame:
    """``n_vectors, dim, n_shards, n_links`` of a graph."""
    return graph.agg(
        F.count("*").alias("n_vectors"), F.max(F.size("embedding")).cast("long").alias("dim"), F.countDistinct("shard").alias("n_shards"), F.coalesce(F.sum(F.size("links")), F.lit(0)).cast("long").alias("n_links"),
    )
