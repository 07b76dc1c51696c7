"""Connected components, of few edges and of many, and what the driver gives back."""

import random

import pytest

from quern import shared
from quern.llm.graph import components
from quern.shared import Scratch


def reachable(edges):
    """The smallest node reachable, for every node that isn't itself that."""
    least = {x: x for e in edges for x in e}
    while True:
        after = least | {}
        for u, v in edges:
            after[u] = after[v] = min(after[u], after[v])
        if after == least:
            return {x: y for x, y in least.items() if x != y}
        least = after


def graphs():
    rng = random.Random(5)
    yield "empty", []
    yield "loops", [(3, 3), (-4, -4)]
    yield "chain", [(i + 1, i) for i in range(300)]
    yield "hub", [(50, i) for i in range(100)] + [(i, 50) for i in range(100)]
    yield "random", [(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(260)]
    yield "large ids", [(2**63 - 1, -(2**63)), (2**63 - 1, 7)]


@pytest.mark.parametrize("few", [-1, 20_000])
def test_components_equal_brute_force(spark, few):
    for name, edges in graphs():
        found = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "graph"), few).collect()
        assert {r["node"]: r["component"] for r in found} == reachable(edges), name
        assert len(found) == len(reachable(edges)), name


def test_few_edges_take_few_jobs(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "u long, v long")
    spark.sparkContext.setJobGroup("few edges", "components of a chain")
    try:
        assert components(edges, Scratch(spark, "graph")).count() == 300
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_release_gives_native_memory_back(spark, monkeypatch):
    said = []
    monkeypatch.setattr(shared, "trim", lambda s, trim=shared.trim: said.append(trim(s)))
    shared.Scratch(spark, "release").release()
    assert len(said) == 1
    assert said[0] is None or said[0].startswith("Trim native heap")
