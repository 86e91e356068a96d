import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, hybrid, vectors
from graphloom.sources.schema import EDGES, NODES, VECTORS


def make(spark, n, edges):
    return spark.createDataFrame([(i, f"n{i}") for i in n], NODES), spark.createDataFrame(edges, EDGES)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_chain(spark):
    nodes, edges = make(spark, range(1, 6), [(i, i + 1, 0) for i in range(1, 5)])
    assert ids(graph.k_hop(nodes, edges, 1, 2)) == [1, 2, 3]
    assert ids(graph.k_hop(nodes, edges, 1, 3)) == [1, 2, 3, 4]
    assert ids(graph.k_hop(nodes, edges, 3, 1)) == [2, 3, 4]
    assert [r.id for r in graph.shortest_path(edges, 1, 3).orderBy("position").collect()] == [1, 2, 3]
    assert [r.id for r in graph.shortest_path(edges, 2, 2).collect()] == [2]
    assert graph.shortest_path(edges, 1, 99).isEmpty()


def test_kinds_and_removal(spark):
    nodes, edges = make(spark, [1, 2, 3], [(1, 2, 0), (1, 3, 1), (1, 2, 0), (3, 3, 2), (1, 9, 0)])
    assert ids(graph.by_edge_kind(nodes, edges, 1, 0)) == [2, 2]
    assert ids(graph.by_edge_kind(nodes, edges, 2, 0, "both")) == [1, 1]
    assert {r.id: r.degree for r in graph.degree(edges).collect()} == {1: 4, 2: 2, 3: 3, 9: 1}
    assert graph.remove_edge(edges, 1, 2).count() == 4
    n, e = graph.remove_node(nodes, edges, 1)
    assert ids(n) == [2, 3] and e.count() == 1
    assert ids(graph.neighbors(edges, 3)) == [1, 3]


def test_star_with_cap(spark):
    nodes, edges = make(spark, range(1, 12), [(1, i, 0) for i in range(2, 12)])
    assert graph.k_hop(nodes, edges, 1, 1).count() == 11
    assert graph.k_hop(nodes, edges, 1, 1, neighbor_cap=5).count() == 6


def test_explore_and_orphans(spark):
    nodes, edges = make(spark, [1, 2, 3, -5, -6], [(1, 2, 0), (2, -5, 2)])
    r = {x.id: (x.outgoing, x.incoming) for x in graph.explore(nodes, edges, 1, 1).collect()}
    assert r == {1: ([2], []), 2: ([-5], [1])}
    assert ids(graph.orphans(nodes, edges)) == [-6, 3]
    assert ids(graph.orphaned_concepts(nodes, edges)) == [-6]
    with pytest.raises(KeyError):
        graph.explore(nodes, edges, 77)


def test_khop_equals_model(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(3)) for _ in range(45)]
    nodes_, edges_ = make(spark, range(0, 36), edges)
    starts = spark.createDataFrame([(0,), (7,)], "source long")
    got = {(r.source, r.id): r.depth for r in graph.k_hop(nodes_, edges_, starts, 4).collect()}
    want = {}
    for s in (0, 7):
        level, seen = {s}, {s: 0}
        for d in range(1, 5):
            level = {y for a, b, _ in edges for x, y in ((a, b), (b, a)) if x in level} - seen.keys()
            seen |= dict.fromkeys(level, d)
        want |= {(s, i): d for i, d in seen.items() if i < 36}
    assert got == want


def test_hybrid(spark):
    nodes, edges = make(spark, [1, 2, 3, 4], [(1, 2, 0), (2, 3, 2), (2, 4, 1), (3, 4, 3)])
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in ((1, (1, 0, 0, 0)), (2, (0.8, 0.6, 0, 0)), (3, (0, 1, 0, 0)), (4, (0.2, 0.2, 0.9, 0)))], VECTORS)
    top = vectors.top_k(vecs, 1, 3).collect()
    assert top[0].id == 2 and abs(top[0].similarity - 0.8) < 1e-6
    r = hybrid.hybrid(nodes, edges, vecs, 1, 1, 3)
    assert ids(r.related_nodes) == [1, 2] and r.similar_vectors.count() == 3
    assert r.similar_vectors.agg(F.max("similarity")).first()[0] == pytest.approx(0.8, abs=1e-6)
    assert ids(hybrid.hybrid(nodes, edges, vecs, 1, 1, 10, dedup=True).similar_vectors) == [1, 2, 3, 4]
