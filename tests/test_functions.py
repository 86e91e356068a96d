"""Byte and hash expressions against plain Python, and the JSON files of a snapshot tree."""

import json
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.functions import exprs
from graphloom.operators import memory, metrics
from graphloom.sources import store

TEXTS = ["plain words", "née à Zürich", "日本語 😀", "", "aaaa\nb\n\n\0\0", "z" * 5000, None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").cache()


def by_id(df):
    return {r[0]: r[1] for r in df.collect()}


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def djb2(t):
    h = 5381
    for b in t.encode():
        h = (h * 33 + b) % (1 << 64)
    return h


def test_bytes(texts):
    got = by_id(texts.select("id", F.struct(exprs.djb2("t").alias("d"), exprs.checksum("t").alias("c"), exprs.runs("t").alias("r"), exprs.from_runs(exprs.runs("t")).alias("back"), exprs.byte_entropy("t").alias("e"))))
    for i, t in enumerate(TEXTS[:-1]):
        assert got[i].d == signed(djb2(t)) and got[i].c == zlib.crc32(t.encode()) and got[i].back == t
        assert sum(r.n for r in got[i].r) == len(t) and all(a.c != b.c for a, b in zip(got[i].r, got[i].r[1:]))
        p = np.unique(list(t.encode()), return_counts=True)[1] / max(1, len(t.encode()))
        assert got[i].e == pytest.approx(-(p * np.log2(p)).sum())
    assert list(got[len(TEXTS) - 1])[:3] == [None, None, None] and got[len(TEXTS) - 1].e is None


def test_text_embed(texts):
    got = by_id(texts.select("id", exprs.text_embed("t", 16)))
    assert got.pop(len(TEXTS) - 1) is None
    for i, v in got.items():
        b = TEXTS[i].encode()
        seed = xxhash.xxh64_intdigest(djb2(TEXTS[i]).to_bytes(8, "little"), 42)
        noise = [signed(xxhash.xxh64_intdigest(j.to_bytes(4, "little"), seed)) / (1 << 63) for j in range(16)]
        raw = np.clip([0.3 * (b[j] / 255 if j < len(b) else 0) + 0.2 * len(b) / 1000 + 0.5 * noise[j] for j in range(16)], -1, 1)
        assert v == pytest.approx(raw / np.linalg.norm(raw), abs=1e-6)


def test_cache_key(spark):
    def key(*parts):
        h = 14695981039346656037
        for p in parts:
            h = ((h ^ (p % (1 << 64))) * 1099511628211) % (1 << 64)
        return signed(h)

    rows = [(0, 0), (1, 10), (-1, 5), ((1 << 63) - 1, -(1 << 63))]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a long, b long").orderBy("i").select(metrics.cache_key("a", "b"), metrics.cache_key("a")).collect()
    assert [tuple(r) for r in got] == [(key(a, b), key(a)) for a, b in rows]


def test_concept_partners(spark, monkeypatch, tmp_path):
    """The degrees of the concept graph, in many cells, without a row for each pair."""
    from graphloom.plans.queries import QUERIES

    rng = np.random.default_rng(3)
    words = [f"{a}{b}x" for a in "abcdefghij" for b in "abcdefghij"]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 40, 150)] + ["same words here"] * 50 + ["alone"] * 3 + [None, "", "of it", "abx only once"]
    for held in (memory.HELD, 300):
        monkeypatch.setattr(memory, "HELD", held)
        m = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
        out = memory.concept_partners(m)
        of, n = {}, {}
        for t in texts:
            own = set((t or "").split()) - {"of", "it"}
            for w in own:
                of[w], n[w] = of.get(w, set()) | own - {w}, n.get(w, 0) + len(own) - 1
        assert sorted(map(tuple, out.collect())) == sorted((w, len(s), n[w]) for w, s in of.items() if s)
    assert memory.concept_partners(m.limit(0)).isEmpty()
    docs = m.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    assert "slice(" not in QUERIES["concept_pairs"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_concept_partners_writes_each_concept_once(spark, monkeypatch):
    """What is shuffled stays in proportion to the texts, however many blocks meet."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}xyz" for a in "abcdefghij" for b in "abcdefghij" for c in "abc"]
    texts = [" ".join(rng.choice(words, 80, replace=False)) for _ in range(400)]
    m = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    gateway = spark.sparkContext._gateway

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    monkeypatch.setattr(memory, "HELD", 2000)
    before = written()
    assert memory.concept_partners(m).count() == len(words)
    assert written() - before < 8 * sum(map(len, texts))


def test_concept_graph(spark):
    """Memories without concepts, with one, repeated, and null ones."""
    m = spark.createDataFrame([(1, "Red fox runs"), (2, "red FOX"), (3, "fox"), (4, ""), (5, None), (6, "of it")], "id long, content string")
    nodes, edges = memory.concept_graph(m)
    label = by_id(nodes.select("id", "label"))
    assert sorted(label.values()) == ["fox", "red", "runs"]
    named = lambda i: label.get(i, i)
    rows = sorted((str(named(r.src)), named(r.dst), r.kind) for r in edges.collect())
    words = {1: ["red", "fox", "runs"], 2: ["red", "fox"], 3: ["fox"]}
    want = [(str(i), w, 2) for i, ws in words.items() for w in ws] + [(a, b, 4) for ws in words.values() for a in ws for b in ws if a != b]
    assert rows == sorted(want)


def test_snapshot_tree(spark, tmp_path):
    """One folder per kind of file, as snapshot trees have them."""
    tree = {
        "nodes/node-000001.json": [{"id": 10, "label": "Alpha"}, {"id": 11, "label": "Beta"}],
        "nodes/node-000002.json": [{"id": 12, "label": "Gamma"}],
        "edges/edge-000001.json": [{"from": 10, "to": 11, "kind": 3}],
        "memory_contents/memory-000001.json": [{"memory_id": 10, "content": "kept \"words\"\n"}],
        "metadata/snapshot-000001.json": {"snapshot_id": 1, "timestamp": "t", "vector_files": [], "node_files": ["nodes/node-000001.json"], "edge_files": [], "memory_content_files": []},
    }
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(content, indent=1))
    read = lambda f, name: sorted(map(tuple, f(spark, str(tmp_path / name)).collect()))
    assert read(store.read_nodes_json, "nodes") == [(10, "Alpha"), (11, "Beta"), (12, "Gamma")]
    assert read(store.read_edges_json, "edges") == [(10, 11, 3)]
    assert read(store.read_contents_json, "memory_contents") == [(10, 'kept "words"\n')]
    m = store.read_metadata_json(spark, str(tmp_path / "metadata")).first()
    assert m.snapshot_id == 1 and m.node_files == ["nodes/node-000001.json"] and m.edge_files == []
