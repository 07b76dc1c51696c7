"""Connected components of an edge table, by alternating large and small stars.

Each step is a grouped minimum and a join, so no node's neighbours meet in one
task unless they fit; the table after each step is written to the shared
folder. The number of steps grows with the logarithm of the longest path.

Up to ``FEW`` edges, counted first, are joined by the driver instead, with the
same result: each exchange of a step costs the driver a thread and plans, which
for small tables are more than the edges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shared import Scratch

#: Edges that the driver takes at most, 16 bytes each.
FEW = 20_000


class Merged:
    """Components joined so far; the smallest node of each stands for it."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _of_few(edges: DataFrame) -> DataFrame:
    table, merged = edges.toArrow(), Merged()
    for u, v in zip(table["u"].to_pylist(), table["v"].to_pylist(), strict=True):
        merged.join(u, v)
    found = {x: merged.find(x) for x in list(merged.up)}
    node = [x for x, least in found.items() if x != least]
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "component": pa.array([found[x] for x in node], pa.int64())}))


def components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``edges(u, v)`` that isn't itself that."""
    known = scratch.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if known.count() <= few:
        found = scratch.put(_of_few(known))
        scratch.drop(known)
        return found
    mark = None
    while True:
        after = scratch.put(_small_star(_large_star(known)))
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(known)
        known = after
        if seen == mark or not seen[0]:
            return known.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
