"""Reachability without pairs: long chains, forks, cycles and nulls against a plain walk."""

import random

from artifactlake.operators import graphs


def _walk(edges, seeds):
    ways = {}
    for child, parent in edges:
        if child is not None and parent is not None:
            ways.setdefault(child, set()).add(parent)
    seen, todo = set(seeds), list(seeds)
    while todo:
        for nxt in ways.get(todo.pop(), ()):
            if nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)
    return seen


def _run(spark, edges, seeds):
    table = spark.createDataFrame(edges, "child string, parent string")
    found = graphs.reachable(table, spark.createDataFrame([(s,) for s in seeds], "node string"))
    nodes = [r["node"] for r in found.collect()]
    assert len(nodes) == len(set(nodes))
    return set(nodes)


def test_forks_cycles_and_nulls(spark):
    rng = random.Random(4)
    # sparse enough for chains, dense enough for forks and cycles; repeated edges, loops and null ends
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(170)]
    edges += edges[:20] + [("n1", "n1"), (None, "n2"), ("n3", None), ("c1", "c2"), ("c2", "c3"), ("c3", "c1")]
    for seeds in (["n0", "n7", "n7"], ["c2"], ["nowhere"], []):
        assert _run(spark, edges, seeds) == _walk(edges, seeds)
    assert _run(spark, [], ["a"]) == {"a"}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    calls = []
    settle = graphs.settle
    monkeypatch.setattr(graphs, "settle", lambda df: calls.append(1) or settle(df))
    edges = [(f"n{i}", f"n{i + 1}") for i in range(100_000)] + [("n50000", "side"), ("side", "n10")]
    assert _run(spark, edges, ["n40000"]) == {f"n{i}" for i in range(10, 100_001)} | {"side"}
    # 17 doublings there, 18 tables back, a few for the forks
    assert len(calls) < 48
