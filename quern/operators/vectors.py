"""Vectors as ``(id, insert_order, embedding)`` rows: arithmetic and exact nearest neighbours; ``vectorgraph`` has the approximate ones."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shared import ship

#: Queries of a block.
QUERY_BLOCK = 2_000
#: Numbers that a task's distances may take at once.
AT_ONCE = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos, null where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n)


METRICS = {"euclidean": euclidean, "cosine": cosine}


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def upsert(writes: DataFrame) -> DataFrame:
    """``writes(id, embedding, seq)``: the last vector of each id, in the order of first insertion."""
    return writes.groupBy("id").agg(F.min("seq").alias("insert_order"), F.max_by("embedding", "seq").alias("embedding"))


def search(vectors: DataFrame, query: list[float], k: int, metric: str = "euclidean") -> DataFrame:
    """The k nearest to one vector; newer entries first among equals. A bounded top-k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = vectors.withColumn("dist", METRICS[metric](F.col("embedding"), q)).where("dist IS NOT NULL")
    return d.orderBy("dist", F.desc("insert_order")).limit(k).select("id", "dist")


def _nearest(x: np.ndarray, order: np.ndarray, q: np.ndarray, k: int, metric: str) -> list[tuple[float, int]]:
    """Distance and row of the k nearest rows to a vector, newer ones first among equals."""
    step, found = max(1, AT_ONCE // max(1, len(q))), []
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        if metric == "euclidean":
            d = np.sqrt(np.square(part - q).sum(axis=1))
        else:
            with np.errstate(invalid="ignore", divide="ignore"):
                d = 1 - part @ q / (np.sqrt(np.square(part).sum(axis=1)) * np.sqrt(np.square(q).sum()))
        at = np.flatnonzero(np.isfinite(d))
        if len(at) > k:
            at = at[d[at] <= np.partition(d[at], k - 1)[k - 1]]
        found += zip(d[at].tolist(), (-order[lo + at]).tolist(), (lo + at).tolist(), strict=True)
        found = sorted(found)[:k]
    return [(d, i) for d, _, i in found]


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """``query, id, dist, rank`` of the k nearest to each of ``queries(query, q)``, exactly.

    A stated set of queries against all vectors, in blocks: a block of queries
    meets a block of vectors in one task, which keeps the best k of each query.
    Vectors and queries of different lengths don't meet.
    """
    ship(vectors.sparkSession)
    many = max(1, ceil(queries.count() / QUERY_BLOCK))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()

    def find(own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, rows = own.column("id").to_pylist(), []
        order = np.array(own.column("insert_order").to_pylist(), np.int64)
        by_size: dict[int, list[int]] = {}
        vectors_ = own.column("embedding").to_pylist()
        for i, v in enumerate(vectors_):
            if v:
                by_size.setdefault(len(v), []).append(i)
        ready = {n: (np.array(at), np.array([vectors_[i] for i in at], np.float64)) for n, at in by_size.items()}
        for name, q in zip(asked.column("query").to_pylist(), asked.column("q").to_pylist(), strict=True):
            if q and len(q) in ready:
                at, x = ready[len(q)]
                rows += [(name, ids[at[i]], int(order[at[i]]), d) for d, i in _nearest(x, order[at], np.array(q, np.float64), k, metric)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (asked.schema.field("query").type, own.schema.field("id").type, pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query", "id", "insert_order", "dist"])

    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select("id", F.col("insert_order").cast("long").alias("insert_order"), F.col("embedding").cast("array<double>").alias("embedding"), dealt("id", parts).alias("i")).withColumn("j", upto(many))
    right = queries.select("query", F.col("q").cast("array<double>").alias("q"), dealt("query", many).alias("j")).withColumn("i", upto(parts))
    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(find, f"query {query_type}, id {id_type}, insert_order long, dist double")
    best = Window.partitionBy("query").orderBy("dist", F.desc("insert_order"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "id", "dist", "rank")


def stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).cast("long").alias("dim"))
