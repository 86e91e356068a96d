import pytest

from graphloom.engine import Engine, edge_kind
from graphloom.sources.config import Config


def values(df):
    return {r.measure: r.value for r in df.collect()}


def test_insert_query_snapshot(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.insert_batch(
        spark.createDataFrame([(1, "User"), (2, "Document"), (3, "Category"), (4, "Tag")], "id long, label string"),
        spark.createDataFrame([(1, 2, 0), (2, 3, 2), (2, 4, 1), (3, 4, 3)], "src long, dst long, kind short"),
        spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.8, 0.6, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0]), (4, [0.2, 0.2, 0.9, 0.0])], "id long, dims array<float>"),
    )
    assert values(e.stats()) == {"nodes": 4, "edges": 4, "vectors": 4, "memory_contents": 0, "log_entries": 12, "snapshots": 0}
    top = e.similar(1, 3).first()
    assert top.id == 2 and top.similarity == pytest.approx(0.8, abs=1e-6)
    e.snapshot("t")
    e.insert_nodes(spark.createDataFrame([(5, "x"), (2, "Renamed")], "id long, label string"))
    assert values(e.stats())["nodes"] == 5 and e.node(2).first().label == "Renamed"
    assert sorted(r.id for r in e.related(1, 2).collect()) == [1, 2, 3, 4]
    assert e.hybrid(1, 2, 3).similar_vectors.count() == 3 and e.resource("nodes").count() == 5
    e.remove_node(2)
    assert sorted(r.id for r in e.related(1, 2).collect()) == [1]
    assert edge_kind("child_of") == 3 and edge_kind("?") == 2


def test_memory_tools(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Config(snapshot_auto_interval=0))
    e.store_memories(spark.createDataFrame([(1, "User loves banjo"), (2, "banjo lessons")], "id long, content string"))
    assert [r.id for r in e.memories_of_concept("Banjo").collect()] == [1, 2]
    assert e.recall_similar("banjo lessons", 1).first().id == 2 and e.recall("User").first().relevance == 0.8
    e.forget(1)
    assert [r.id for r in e.recent().collect()] == [2]
    assert sorted(r.label for r in e.state().nodes.where("id < 0").collect()) == ["banjo", "lessons"]


def test_numbers_are_dense_and_compaction_keeps_them(spark, tmp_path):
    from graphloom.sources import store

    e = Engine(spark, str(tmp_path / "db"), Config(snapshot_auto_interval=0, log_compaction_keep_recent=5))
    e.insert_nodes(spark.range(1, 41).repartition(6).selectExpr("id", "concat('n', id) AS label"))
    e.insert_edges(spark.range(1, 40).repartition(3).selectExpr("id AS src", "id + 1 AS dst", "0 AS kind"))
    assert sorted(r.seq for r in e.log().collect()) == list(range(1, 80))
    assert store.compact(e.log(), 20).count() == 20
    before = values(e.stats())
    assert e.compact() == 5 and e.last_seq() == 79
    after = values(e.stats())
    assert {k: after[k] for k in ("nodes", "edges")} == {k: before[k] for k in ("nodes", "edges")} == {"nodes": 40, "edges": 39}
    e.insert_nodes(spark.createDataFrame([(41, "new")], "id long, label string"))
    assert e.last_seq() == 80 and e.node(41).first().label == "new"
    again = Engine(spark, str(tmp_path / "db"))
    assert values(again.stats())["nodes"] == 41
    # no limit but the argument's
    assert e.related(1, 14).count() == 15 and e.related(1, None).count() == 11
    assert [r.id for r in e.shortest_path(1, 16).orderBy("position").collect()] == list(range(1, 17))


def test_point_lookup_reaches_the_scan(spark, tmp_path, capsys):
    from graphloom.operators import graph
    from graphloom.sources import store

    e = Engine(spark, str(tmp_path / "db"))
    e.insert_nodes(spark.range(1, 10).selectExpr("id", "'x' AS label"))
    graph.get_node(store.fold(e.log()).nodes, 3).explain("formatted")
    assert "EqualTo(node.id,3)" in capsys.readouterr().out


def test_more_verbs(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), Config(snapshot_auto_interval=0))
    e.insert_batch(spark.range(1, 5).selectExpr("id", "'x' AS label"), spark.createDataFrame([(1, 2, 0), (1, 2, 3), (1, 3, 0)], "src long, dst long, kind short"), spark.createDataFrame([(i, [1.0, i / 10.0]) for i in range(1, 5)], "id long, dims array<float>"))
    assert sorted(r.id for r in e.by_kind(1, "owns").collect()) == [2, 3]
    e.remove_edge(1, 2)
    assert sorted((r.dst, r.kind) for r in e.state().edges.collect()) == [(2, 3), (3, 0)]
    got = e.similar_batch(spark.createDataFrame([(1,), (4,)], "id long"), 1).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, 2), (4, 3)}
    e.clear_vectors()
    assert e.state().vectors.isEmpty()
    e.store_memories(spark.createDataFrame([(1, "old banjo"), (2, "banjo songs")], "id long, content string"))
    e.update_memory(1, "new violin")
    assert {r.id: r.content for r in e.recent().collect()} == {1: "new violin", 2: "banjo songs"}
    assert [r.id for r in e.memories_of_concept("violin").collect()] == [1] and [r.id for r in e.memories_of_concept("banjo").collect()] == [2]
    e.relate(spark.createDataFrame([(1, 2, 3, 0.5)], "src long, dst long, relation short, strength float"))
    e.relate(spark.createDataFrame([(1, 2, 3, 0.75), (2, 1, 4, 0.25)], "src long, dst long, relation short, strength float"))
    assert {(r.src, r.dst, r.relation, r.strength) for r in e.relations().collect()} == {(1, 2, 3, 0.75), (2, 1, 4, 0.25)}
    e.set_session(spark.createDataFrame([(7, 1, "a")], "id long, user_id long, title string"))
    e.set_session(spark.createDataFrame([(7, 1, "b")], "id long, user_id long, title string"))
    s = e.session(7).first()
    assert (s.title, s.interaction_count, s.is_active) == ("b", 2, True) and e.session(8).isEmpty()


def test_lookups_by_files(spark, tmp_path):
    from graphloom.sources import store

    edges = spark.createDataFrame([(i % 20, i, i % 3) for i in range(200)], "src long, dst long, kind short")
    store.write_edges_sorted(edges, f"{tmp_path}/edges", 4)
    assert sorted(r.dst for r in store.lookup_edges(spark, f"{tmp_path}/edges", 7, 1).collect()) == [i for i in range(200) if i % 20 == 7 and i % 3 == 1]
    assert store.range_join(edges, spark.createDataFrame([(3,), (3,), (99,)], "id long")).count() == 10
    store.write_vectors_sorted(spark.createDataFrame([(i, [float(i)]) for i in range(50)], "id long, dims array<float>"), f"{tmp_path}/vectors", 4)
    assert store.lookup_vector(spark, f"{tmp_path}/vectors", 31).first().dims == [31.0]
    a, b, c = (spark.createDataFrame(rows, "id long, content string") for rows in ([(1, "a"), (2, "b")], [(2, "old"), (3, "c")], [(3, "older"), (4, "d")]))
    assert {tuple(r) for r in store.reload([a, b, c], "id").collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}


def test_expressions(spark):
    from pyspark.sql import functions as F

    from graphloom.functions import exprs
    from graphloom.operators import metrics, placement, planner

    d = spark.createDataFrame([("aaab\n\nc\0d",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(exprs.from_runs(exprs.runs("t"))).collect()] == ["aaab\n\nc\0d", "", None]
    assert d.select(exprs.label_text("t"), exprs.checksum(F.lit("123456789"))).first()[:] == ("aaab\n\nc", 0xCBF43926)
    m = spark.createDataFrame([(3, 2, 5, 9, 1, 7, 1, 6, 1, 2000, True), (2, 2, 5, 9, 1, 7, 1, 6, 0, 10, True), (1, 2, None, 9, 1, 7, 1, 6, 0, 2000, False)], "term int, own int, voted int, cand int, lt int, li int, olt int, oli int, prev int, gap int, has_snapshot boolean")
    got = m.select(placement.grants_vote("term", "own", "voted", "cand", ("lt", "li"), ("olt", "oli")), placement.accepts_entries("term", "own", "prev", "lt", "olt"), placement.recovery_mode()).collect()
    assert [tuple(r) for r in got] == [(True, True, "fast"), (False, True, "replay"), (False, False, "replay")]
    q = spark.createDataFrame([("a", i, 10.0 * i, i % 2 == 0, "h") for i in range(1, 4)], "kind string, seq int, duration_us double, is_hit boolean, query_hash string")
    cost = 5.0
    for x in (10.0, 20.0, 30.0):
        cost += 0.1 * (x - cost)
    assert abs(planner.adapted(q, 5.0).first().cost - cost) < 1e-9 and planner.statistics(q).first()[:2] == (3, 1)
    g = spark.createDataFrame([("m", 1, 5.0), ("m", 2, 4.0)], "name string, ts int, value double")
    assert metrics.json_export(metrics.gauges(g)).first().line == '{"name":"m","value":4.0}'
