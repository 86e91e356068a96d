from datetime import datetime

from pyspark.sql import functions as F

from graphloom.operators import memory, metrics, placement, planner
from graphloom.sources import config, store
from graphloom.sources.schema import LOG, MEMORIES


def entries(spark, rows):
    return spark.createDataFrame(rows, LOG)


def node(seq, i, label, deleted=False):
    return (seq, datetime(2024, 1, 1), 0, (i, label), None, None, None, deleted)


def edge(seq, a, b, kind, deleted=False):
    return (seq, datetime(2024, 1, 1), 1, None, (a, b, kind), None, None, deleted)


def vector(seq, i, dims):
    return (seq, datetime(2024, 1, 1), 2, None, None, (i, dims), None, False)


def test_recovery(spark, tmp_path):
    log_path, base = str(tmp_path / "log"), str(tmp_path / "snap")
    store.append(entries(spark, [node(1, 1, "a"), node(2, 2, "b"), edge(3, 1, 2, 1), vector(4, 1, [1.0, 2.0, 3.0])]), log_path)
    store.snapshot(store.fold(store.read_log(spark, log_path)), base, 1, 4, "t1")
    store.append(entries(spark, [node(5, 3, "c"), edge(6, 2, 3, 0), node(7, 0, "no node")]), log_path)
    log = store.read_log(spark, log_path)
    state = store.recover(spark, base, log)
    assert (state.nodes.count(), state.edges.count(), state.vectors.count()) == (3, 2, 1)
    assert sorted(map(tuple, state.nodes.collect())) == sorted(map(tuple, store.fold(log).nodes.collect()))
    store.snapshot(state, base, 2, 7, "t2")
    assert [m["snapshot_id"] for m in store.manifests(spark, base)] == [1, 2]
    assert store.retain(spark, base, 1) == [1] and [m["counts"]["nodes"] for m in store.manifests(spark, base)] == [3]


def test_fold_tombstones(spark):
    log = entries(spark, [node(1, 1, "a"), node(2, 1, "b"), node(3, 2, "x"), node(4, 2, "x", True), edge(5, 1, 2, 0), edge(6, 1, 2, 0), edge(7, 1, 2, 0, True), edge(8, 1, 2, 0)])
    s = store.fold(log)
    assert [tuple(r) for r in s.nodes.collect()] == [(1, "b")] and s.edges.count() == 1
    assert store.compact(log, 3).count() == 3 and store.compact(log, 99).count() == 8


def test_json_and_blob(spark, tmp_path):
    import numpy as np

    (tmp_path / "n.json").write_text('[\n{"id": 1, "label": "TestNode"}\n]')
    (tmp_path / "e.json").write_text('[{"from": 1, "to": 2, "kind": 2}]')
    assert [tuple(r) for r in store.read_nodes_json(spark, str(tmp_path / "n.json")).collect()] == [(1, "TestNode")]
    assert [tuple(r) for r in store.read_edges_json(spark, str(tmp_path / "e.json")).collect()] == [(1, 2, 2)]
    rows = np.array([(7, [1.5] * 4), (8, [2.5] * 4)], np.dtype([("id", "<i8"), ("d", "<f4", (4,))]))
    (tmp_path / "v.blob").write_bytes(rows.tobytes())
    assert [(r.id, r.dims) for r in store.read_vector_blob(spark, str(tmp_path / "v.blob"), 4).orderBy("id").collect()] == [(7, [1.5] * 4), (8, [2.5] * 4)]


def test_log_stream(spark, tmp_path):
    from graphloom.streaming import streams

    log_path, base = str(tmp_path / "log"), str(tmp_path / "snap")
    store.append(entries(spark, [node(i, i, f"n{i}") for i in range(1, 9)]), log_path)
    q = streams.snapshot_every(streams.log_stream(spark, log_path), log_path, base, str(tmp_path / "cp"), every=5).start()
    q.processAllAvailable()
    q.stop()
    assert store.manifests(spark, base)[-1]["counts"]["nodes"] == 8


def test_memory(spark):
    t = datetime(2024, 1, 1)
    kinds = [(5, 3, 3, 0), (6, 3, 2, 1), (2, 2, 3, 1), (0, 3, 3, 3), (3, 2, 3, 1)]
    m = spark.createDataFrame([(i + 1, k, f"memory {i + 1}", c, im, s, t, t, 0, 1, 1, 1) for i, (k, c, im, s) in enumerate(kinds)], MEMORIES)
    run = lambda **a: [r.id for r in memory.query_memories(m, memory.MemoryQuery(**a)).collect()]
    assert run(session_id=1) == [5, 4, 3, 2, 1] and run(min_importance=3) == [5, 4, 3, 1] and run(memory_types=[5]) == [1]
    new = memory.update(m, spark.createDataFrame([(2, "changed")], "id long, content string")).where("id = 2").first()
    assert new.content == "changed" and new.version == 2
    assert [r.relevance for r in memory.recall_text(m, "memory 3").collect()] == [1.0]
    more = memory.store(m, m.limit(1).withColumn("content", F.lit("new")))
    assert more.agg(F.max("id")).first()[0] == 6


def test_metrics_and_planner(spark):
    ops = spark.createDataFrame([("x", float(v)) for v in (50, 150, 750, 2500)], "op string, duration_us double")
    h = {r.bound: r for r in metrics.histogram(ops, bounds=(100, 500, 1000, 5000)).collect()}
    assert [h[float(b)].cumulative for b in (100, 500, 1000, 5000)] == [1, 2, 3, 4]
    assert (h[100.0].total, h[100.0].sum, h[100.0].mean) == (4, 3450, 862.5)
    assert metrics.percentile(ops, 0.5, bounds=(100, 500, 1000, 5000)).first().bound == 500
    grid = spark.createDataFrame([(1, "range", 10000, 0.05), (2, "range", 10000, 0.3), (3, "complex", 10000, 0.005), (4, "complex", 8000, 0.1), (5, "complex", 1000, 0.1)], "i int, pattern string, n int, selectivity double")
    got = grid.withColumn("cached", F.lit(False)).orderBy("i").select(planner.strategy()).collect()
    assert [r[0] for r in got] == ["index", "scan", "index", "hybrid", "scan"]
    assert spark.range(1).select(planner.should_use_index(10000, 0.01), planner.should_use_index(1000, 0.8)).first()[:] == (True, True)


def test_placement(spark):
    keys = spark.range(300).select((F.col("id") * 7919 + 13).alias("key"))
    share = {r.node_id: r["items"] for r in placement.load(placement.place(keys, placement.ring(spark, [1, 2, 3], 50))).collect()}
    assert sum(share.values()) == 300 and all(40 <= n <= 160 for n in share.values())
    clocks = spark.sql("SELECT map(1L, 2L) AS a, map(1L, 1L, 2L, 0L) AS b, map(2L, 5L) AS c")
    assert clocks.select(placement.compare_clocks("a", "b"), placement.compare_clocks("b", "a"), placement.compare_clocks("a", "c"), placement.compare_clocks("a", "a")).first()[:] == ("after", "before", "concurrent", "equal")
    assert clocks.select(placement.clock_tick("a", 2)).first()[0] == {1: 2, 2: 1}
    members = spark.createDataFrame([(i, i < 4) for i in range(7)], "node_id long, reachable boolean")
    assert placement.quorum(members).first().asDict() == {"members": 7, "reachable": 4, "needed": 4, "has_quorum": True}


def test_config():
    c = config.parse("# a comment\nvector_similarity_threshold = 0.7\nhealth_memory_warning_bytes = 64MB\nno_such_key = 1\n")
    assert c.vector_similarity_threshold == 0.7 and c.health_memory_warning_bytes == 64 << 20 and config.parse_size("2GB") == 2 << 30
