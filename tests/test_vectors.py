import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import exprs
from graphloom.operators import vectors
from graphloom.sources.schema import VECTORS


def make(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], VECTORS)


def test_top_k_and_threshold(spark):
    v = make(spark, [(1, (1, 0, 0, 0)), (2, (0.9, 0.1, 0, 0)), (3, (0, 1, 0, 0)), (4, (0, 0, 1, 0)), (5, (0.7, 0.7, 0, 0))])
    assert [r.id for r in vectors.top_k(v, 1, 3).collect()] == [2, 5, 3]
    t = make(spark, [(1, (1, 0, 0)), (2, (0.8, 0.6, 0)), (3, (0.1, 0, 0)), (4, (0, 0, 0))])
    assert [r.id for r in vectors.threshold(t, 1, 0.9).collect()] == [3]
    with pytest.raises(KeyError):
        vectors.top_k(v, 99, 3)
    with pytest.raises(KeyError):
        vectors.batch_top_k(v, v.select((F.col("id") + 50).alias("id")), 2)
    m = {(r.a, r.b): r.similarity for r in vectors.similarity_matrix(t, [1, 3, 4, 9]).collect()}
    assert m[1, 3] == pytest.approx(1) and m[9, 9] == 1 and m[1, 9] == 0 and m[1, 4] == 0


def test_search_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).astype("f4")
    x[5] = 0
    v = make(spark, list(enumerate(x)))
    got = {}
    for r in vectors.search(v, v.where("id % 7 = 0"), k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    n = np.linalg.norm(x.astype("f8"), axis=1)
    s = np.divide(x.astype("f8") @ x.T.astype("f8"), np.outer(n, n), out=np.zeros((60, 60)), where=np.outer(n, n) > 0)
    for q, found in got.items():
        order = [i for i in np.lexsort((np.arange(60), -np.round(s[q], 12))) if i != q][:4]
        assert found == order


def test_kmeans_quantize_ann(spark):
    v = make(spark, [(1, (1, 0, 0)), (2, (0.9, 0.1, 0)), (3, (0, 0, 1)), (4, (0, 0.1, 0.9))])
    marked, centres = vectors.k_means(v, 2, 10)
    assert marked.select("cluster").distinct().count() == 2 and len(centres) == 2
    back = vectors.dequantize(vectors.quantize(v)).join(v.withColumnRenamed("dims", "was"), "id").collect()
    assert all(abs(a - b) <= 1 / 255 + 1e-6 for r in back for a, b in zip(r.dims, r.was))
    rng = np.random.default_rng(1)
    big = make(spark, list(enumerate(rng.standard_normal((400, 16)))))
    index = vectors.Ivf(big, cells=8)
    exact = {(r.query_id, r.id) for r in vectors.search(big, big.where("id % 50 = 0"), k=10).collect()}
    near = {(r.query_id, r.id) for r in index.search(big.where("id % 50 = 0"), 10, probes=7).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert index.stats().agg(F.sum("vectors")).first()[0] == 400


def test_ann_with_registered_parameters_misses_nothing(spark):
    rng = np.random.default_rng(2)
    v = make(spark, list(enumerate(rng.standard_normal((600, 64)))))
    asked = v.where("id % 50 = 0")
    exact = {(r.query_id, r.id, r["rank"]) for r in vectors.search(v, asked, k=10).collect()}
    assert {(r.query_id, r.id, r["rank"]) for r in vectors.Ivf(v).search(asked, 10).collect()} == exact


def test_expressions(spark):
    t = "User loves playing banjo and learning Zig programming language"
    row = spark.createDataFrame([(t,)], "t string").select(exprs.concepts("t").alias("c"), exprs.hash_embed("t", 16).alias("e"), exprs.byte_entropy("t").alias("h")).first()
    assert row.c == ["user", "loves", "playing", "banjo", "learning", "zig", "programming", "language"]
    assert np.linalg.norm(row.e) == pytest.approx(1, abs=1e-5)
    p = np.unique(list(t.encode()), return_counts=True)[1] / len(t)
    assert row.h == pytest.approx(-(p * np.log2(p)).sum())

    def fnv(s):
        h = 14695981039346656037
        for b in s.encode():
            h = ((h ^ b) * 1099511628211) % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    words = ["", "banjo", "é", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(exprs.fnv1a64("w")).collect()]
    assert got == [fnv(w) for w in words]
    assert spark.range(1).select(exprs.unsigned(F.lit(-1))).first()[0] == (1 << 64) - 1
    exprs.register(spark)
    assert spark.sql("SELECT cosine_sim(array(1D, 0D), array(1D, 1D)), size(concepts('the banjo sings'))").first()[0] == pytest.approx(0.5**0.5)


def test_byte_entropy_of_every_row(spark, tmp_path):
    from graphloom.plans.queries import QUERIES

    texts = ["plain", "née à Zürich", "日本語 😀", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.entropy for r in QUERIES["byte_entropy"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(5)) and got[4] is None
    for i, t in enumerate(texts[:4]):
        p = np.unique(list(t.encode()), return_counts=True)[1] / max(1, len(t.encode()))
        assert got[i] == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-6)


def test_ann_meets_in_blocks(spark, monkeypatch):
    """Cells of several blocks, copies, zero, null and non-finite vectors: the brute force's rows, and no row for a pair that isn't among a block's best."""
    monkeypatch.setattr(vectors, "DATA_BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 8)).round(2)
    x[100:160] = x[0]
    x[200] = 0
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    rows += [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (503, [float("inf")] + [1.0] * 7)]
    v = spark.createDataFrame(rows, "id long, dims array<double>")
    index = vectors.Ivf(v, cells=8)
    assert index.stats().agg(F.sum("vectors")).first()[0] == 504
    found = index.search(v.where("id % 50 = 0"), 10)
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    s = np.round(unit @ unit.T, 12)
    np.fill_diagonal(s, -9)
    want = {(q, int(i), n + 1) for q in range(0, 500, 50) for n, i in enumerate(np.lexsort((np.arange(500), -s[q]))[:10])}
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "CoGroups" in plan and "id <> query_id" not in plan and "NOT (id" not in plan
    assert index.search(v.where("id < 0"), 10).isEmpty()
