"""Cycles, longest paths and closures by brute force, and in how few rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import dag, graph
from sightline.operators.checks import InvalidInput
from sightline.operators.gates import route_graph_problems
from sightline.operators.identity import check_dag, invalidation_closure


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def plain_settle(pairs):
    """Nodes that trimming from both ends leaves, and the longest path if there are none."""
    left = set(pairs)
    while True:
        starts, ends = {a for a, _ in left}, {b for _, b in left}
        kept = {(a, b) for a, b in left if a in ends and b in starts}
        if kept == left:
            break
        left = kept
    depth = {}

    def longest(n):
        if n not in depth:
            depth[n] = max((1 + longest(b) for a, b in pairs if a == n), default=0)
        return depth[n]

    return bool(left), None if left else max((longest(a) for a, _ in pairs), default=0)


@pytest.mark.parametrize("seed", range(4))
def test_settle_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(dag, "SLOW", [0.0, 0.5, 0.0, 0.9][seed])  # with 0 every round shortens too
    rng = random.Random(seed)
    for _ in range(2):
        n = rng.randint(5, 14)
        pairs = {(f"n{a:02d}", f"n{b:02d}") for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(rng.randint(4, 16)))}
        if rng.random() < 0.4:
            a, b = rng.choice(sorted(pairs))
            pairs.add((b, a))
        cyclic, longest = plain_settle(pairs)
        for stop in (False, True):
            found = dag.settle(edges_of(spark, sorted(pairs)), "a", "b", stop_at_cycle=stop)
            assert bool(found.cyclic.count()) == cyclic
            if not cyclic:
                assert found.longest == longest


def test_a_long_chain_is_settled_in_few_rounds(spark):
    n = 100_000
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    chain = spark.range(n - 1).select(name(F.col("id")).alias("artifact"), name(F.col("id") + 1).alias("dependency"))
    found = dag.settle(chain, "artifact", "dependency")
    assert (found.longest, found.cyclic.count()) == (n - 1, 0) and found.rounds <= 40
    closed = chain.unionByName(spark.createDataFrame([(f"n{n - 1}", "n0")], chain.schema))
    shut = dag.settle(closed, "artifact", "dependency", stop_at_cycle=True)
    assert shut.cyclic.limit(1).count() and shut.rounds <= 40
    # a closed chain with a long way into it, and no early stop
    led = dag.settle(closed.union(spark.range(1000).select(F.concat(F.lit("m"), F.col("id").cast("string")), F.when(F.col("id") == 999, F.lit("n5")).otherwise(F.concat(F.lit("m"), (F.col("id") + 1).cast("string"))))), "artifact", "dependency")
    assert led.cyclic.limit(1).count() and led.rounds <= 40
    reached, rounds = dag.closure(closed, "artifact", "dependency", spark.createDataFrame([(f"n{n - 1}",), ("n40000",)], "node string"))
    row = reached.agg(F.count("*"), F.max("depth"), F.sum("depth")).first()
    assert tuple(row) == (n, 59_998, sum(range(59_999)) + sum(range(40_001))) and rounds <= 40


def plain_closure(pairs, roots):
    depth = dict.fromkeys(roots, 0)
    front = list(roots)
    while front:
        more = []
        for a, b in pairs:
            if b in front and a not in depth:
                depth[a] = depth[b] + 1
                more.append(a)
        front = more
    return depth


@pytest.mark.parametrize("seed", range(3))
def test_closure_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(dag, "PLAIN_LAYERS", seed)
    rng = random.Random(seed)
    names = [f"n{k:02d}" for k in range(24)]
    pairs = sorted({tuple(rng.sample(names, 2)) for _ in range(18)} | {(names[k], names[k + 1]) for k in range(0, 20) if k % 7})
    roots = rng.sample(names, 2)
    found, _ = dag.closure(edges_of(spark, pairs), "a", "b", spark.createDataFrame([(r,) for r in roots], "node string"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == plain_closure(pairs, roots)


def test_graphs_that_break_rules(spark):
    nodes = spark.createDataFrame([(n, "k") for n in "abcd"], "artifact string, kind string")
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "artifact string, dependency string")
    assert check_dag(nodes, edges(("a", "b"), ("b", "c"), ("a", "c"))) == 3
    assert check_dag(nodes, edges(("a", "b")).limit(0)) == 1
    for bad in ([("a", "b"), ("b", "a")], [("a", "a")], [("a", "x")]):
        with pytest.raises(InvalidInput):
            check_dag(nodes, edges(*bad))
    closed = invalidation_closure(nodes, edges(("a", "b"), ("b", "c")), nodes.where("artifact = 'c'"))
    assert sorted(map(tuple, closed.collect())) == [("a", 2), ("b", 1), ("c", 0)]


def test_route_graphs_are_settled_together(spark):
    graphs = spark.createDataFrame([(g,) for g in "pqr"], "graph_id string")
    nodes = spark.createDataFrame([(g, i, n) for g in "pqr" for i, n in enumerate("abcd")], "graph_id string, position int, node string")
    pairs = {"p": [("a", "b"), ("b", "c"), ("c", "d")], "q": [("a", "b"), ("b", "c"), ("c", "b")], "r": [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")]}
    edges = spark.createDataFrame([(g, i, s, t) for g, some in pairs.items() for i, (s, t) in enumerate(some)], "graph_id string, position int, source string, target string")
    assert [tuple(r) for r in route_graph_problems(graphs, nodes, edges).collect()] == [("q", "cycle")]


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_in_rounds_and_in_one_task(spark, few):
    rng = random.Random(few)
    pairs = [tuple(rng.sample(range(60), 2)) for _ in range(45)] + [(1, 1), (70, 71), (71, 72)]
    root = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = graph.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", few=few)
    assert dict(map(tuple, found.collect())) == root and found.count() == len(root)
    assert graph.components(spark.createDataFrame([], "a string, b string"), "a", "b", few=few).collect() == []
