import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import collision_ann, mixing, pii, toxicity, warc
from graphloom.llm.common import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_ann_recall_and_small_tables(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)).astype("f4")
    x[7], x[11] = 0, x[12]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5020, [float("nan")] * 32, 1), (None, x[0].tolist(), 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in collision_ann.search(d, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y, hit = x.astype("f8"), 0
    ok = np.flatnonzero((x != 0).any(axis=1))
    assert set(got) == {i for i in range(0, 3000, 20)}
    for q, found in got.items():
        s = y[ok] @ y[q]
        order = [i for i in ok[np.lexsort((ok, -s))] if i != q][:20]
        hit += len({i for i, _ in found} & set(order))
        assert len(found) == 20 and all(abs(v - y[i] @ y[q]) < 1e-9 for i, v in found) and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit / (20 * len(got)) >= 0.9
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>, rank int")
    assert [r.vec_id for r in collision_ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [i for i in np.lexsort((np.arange(5), -(y[:5] @ y[0]))) if i != 0]
    assert collision_ann.search(few.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("n", F.lit(2))


def test_warc_round_trip(spark):
    rows = [(5, "http://a b/\n", "same"), (3, None, "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (4, "é", "é\r\n\r\nWARC/1.1\r\n" * 50), (None, "u", "same"), (7, "u", "x" * 200_000), (3, "u", "same")]
    folder = scratch(spark, "warc")
    index = warc.write(pages(spark, rows), folder)
    got = warc.read(index, folder).collect()
    assert all(r.intact for r in got)
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((j for j, _, k in rows if (k or "") == (h or "") and j is not None), default=None)
        again = first is not None and i != first
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {(h or "") for _, _, h in rows}
    some = warc.read(index.where("page_id = 4"), folder).collect()
    assert [r.payload.decode() for r in some] == [rows[5][2]]
    empty = scratch(spark, "warc")
    assert warc.read(warc.write(pages(spark, rows).limit(0), empty), empty).isEmpty()
    large = scratch(spark, "warc")
    assert warc.write(pages(spark, rows), large, least=100).where("record_type = 'revisit'").isEmpty()


def test_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (100_000, 1), (100_010, 1)]) == [(0, 15, [0, 1]), (100_000, 100_011, [2, 3])]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) // 10 + 2 * int(c) % 10 for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]

    found = sorted((m.start(), r, m.end()) for r, k in enumerate(BASE) for m in re.finditer(BASE[k], t) if ok(k, m.group()))
    return ",".join(f"{pii.KINDS[r]}:{s}:{e}" for s, r, e in found)


def test_pii_base_spans(spark, docs, odd):
    rng = random.Random(4)
    parts = ["a", "b.", "@", "x@y.z", "..", "%", "-", " ", "1", "22", ".", "255", "+1 ", "(", "555", ")", "4111 1111 1111 1111", "é", "😀", "4111-1111-1111-1111", "\n", "300.1.1.1.2", "a@b.c..d@e.f", "0"]
    texts = ["x" * 3000 + "@" + "a." * 3000 + "b", "1" * 5000, "1-" * 3000 + "1", "1." * 4000, "+1" + " ()" * 3000, " ".join(["+1 (555) 555-1234 a@b.co 1.2.3.4"] * 200)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    rows = [*odd, *((100 + i, t) for i, t in enumerate(texts))]
    found = pii.find(docs(rows)).select("text", pii._joined("base").alias("b"), pii._joined("spans").alias("s")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.b == brute_spans(r.text or "")
        assert set(r.b.split(",")) <= set(r.s.split(",")) or not r.b
    assert pii.find(docs([]).limit(0)).isEmpty()


def test_pii_query_counts_and_digest(docs, odd, tmp_path):
    """Counts by kind, wherever among a text's spans those of a kind stand."""
    texts = ["1.2.3.4", "+1 (555) 555-1234", "4111 1111 1111 1111", "a@b.co c@d.co", "+1 (555) 555-1234, 1.2.3.4 5.6.7.8 a@b.co", "4111-1111-1111-1111 x@y.z 9.9.9.9 +1 555 555 1234 x@y.z"]
    rows = [*odd, *((100 + i, t) for i, t in enumerate(texts))]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = pii.op9_pii(docs([]).sparkSession, str(tmp_path)).collect()

    def want(doc_id, text):
        base = brute_spans(text or "")
        kinds = [x.split(":")[0] for x in base.split(",")]
        return str(doc_id), *map(kinds.count, pii.KINDS), hashlib.sha256(base.encode()).hexdigest()

    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == sorted(want(*r) for r in rows)


def test_pii_added_spans_and_redaction(docs):
    d = docs([(1, "please call 555-123-4567 now"), (2, "mail me: joe at example dot com ok"), (3, "nothing here at all. dot com"), (4, "to a@b.co and +1 (555) 555-1234!"), *((10 + i, f"write a{i}@b.com or call +1 555 555 12{i}4") for i in range(10))])
    out = {r.doc_id: r for r in pii.redact(d).collect()}
    assert out[1].text == "please call <PHONE> now" and out[3].text == "nothing here at all. dot com"
    assert out[4].text == "to <EMAIL> and <PHONE>!" and out[4].n_chars == len(out[4].text)
    assert "joe" not in out[2].text and pii.redact(d).columns == d.columns


def test_reliabilities():
    rows = [{"kind": "card", "long": 1, "strict": 1, "checked": 1, "gazetteer": 1, "context": 0, "shape": 1, "n": 500}, {"kind": "card", "long": 1, "strict": 0, "checked": -1, "gazetteer": -1, "context": -1, "shape": -1, "n": 500}]
    em = pii.Reliabilities(rows)
    assert em.posterior(rows[0]) > 0.95 > 0.05 > em.posterior(rows[1])
    weights = pii.span_classifier(rows, em.posterior)
    score = [sum(weights.get(f, 0) for f in pii._features(r)) for r in rows]
    assert score[0] > 0 > score[1]


def test_mixing(spark, docs, odd):
    rng = random.Random(9)
    rows = [*odd, *((100 + i, " ".join(f"w{j}" for j in range(rng.randrange(0, 900)))) for i in range(400))]
    d = docs(rows).withColumn("source", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("source")))
    m = mixing.mix(d).collect()
    assert sorted(map(str, m)) == sorted(map(str, mixing.mix(d).collect()))
    by = defaultdict(lambda: [0, 0, 0.0])
    source = {r.doc_id: r.source for r in d.collect()}
    sizes = {}
    for r in m:
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(x["last"] - x["first"] for x in r.draws)
        own = by[source[r.doc_id]]
        own[0] += r.taken
        own[1], own[2] = r.source_size, r.target
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
    assert all(sizes[s] == own[1] and abs(own[0] - own[2]) <= 2 * mixing.BLOCK for s, own in by.items())
    assert sum(own[2] for own in by.values()) == pytest.approx(1.5 * sum(sizes.values()))
    # no part of a document is drawn twice in a pass
    for r in m:
        seen = sorted((x["pass"], x["first"], x["last"]) for x in r.draws)
        assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(seen, seen[1:]))
    assert mixing.mix(docs([]).limit(0)).isEmpty()
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in m)


def test_split_is_exact():
    quotas = [1000, 0, 37, 5]
    counts = mixing.split(quotas, 7, 3)
    assert counts.sum(axis=0).tolist() == quotas and counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1
    assert mixing.split([10**10, 10**9], 4, 1).sum(axis=0).tolist() == [10**10, 10**9]
    with pytest.raises(ValueError):
        mixing.split([1] * 1000, 10_000, 1)


def test_permutation():
    for n in (1, 2, 3, 64, 65, 1000):
        x = np.arange(n)
        assert sorted(mixing.permuted(x, np.full(n, n), np.full(n, 12345, "u8"))) == list(range(n))


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200.0, 500 / 3, 250 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def corpus(rng, n):
    words = [a + b + c for a in ("ba", "re", "to", "mi") for b in ("lu", "sa", "ni") for c in ("", "r", "na")]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(max(2, len(t) // 40)):
                t.insert(rng.randrange(len(t)), rng.choice(["vile", "grotto" + rng.choice(words)]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(rng.random() < 0.5), int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, docs):
    rows, labels = corpus(random.Random(1), 1200)
    d, known = docs(rows), spark.createDataFrame(labels[:800], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, known)
    got = {r.doc_id: r.toxic for r in toxicity.score(d, model).collect()}
    pairs = Counter((bool(t), got[i]) for i, _, t in labels[800:])
    assert pairs[True, True] >= 0.9 * (pairs[True, True] + pairs[True, False]) and pairs[False, True] <= 4
    kept = toxicity.without_toxic(d, known)
    assert kept.columns == d.columns and kept.count() == sum(not x for x in got.values())


def test_toxicity_odd_tables(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(odd)
    assert toxicity.without_toxic(d, none).count() == len(odd)
    some = spark.createDataFrame([(1, None, 1), (None, 1, 1), (4, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, toxicity.train(d, some)).where("toxic").isEmpty()
    assert toxicity.score(d.limit(0), toxicity.train(d.limit(0), some)).isEmpty()


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(2)
    y0 = rng.random(600) < 0.5
    y1 = y0 ^ (rng.random(600) < 0.05)
    x = (np.flatnonzero(y0), np.zeros(int(y0.sum()), "i8"), np.ones(int(y0.sum())))
    models = toxicity.fit_chain(x, np.column_stack([y0, y1]).astype("f8"), np.arange(600) % 3, 1)
    p = toxicity.Chain(("a", "b"), {}, models)
    assert len(models[1].chained) == 1 and models[0].chained.shape == (0,) and p.categories == ("a", "b")
    assert ((models[1].predict(x, 600, toxicity.odds(models[0].predict(x, 600, np.zeros((600, 0))))[:, None]) > 0.5) == y0).mean() > 0.99


def test_pipeline_on_odd_rows(spark, docs, odd, tmp_path):
    import corpus_pipeline

    rows, labels = corpus(random.Random(3), 150)
    d = docs([*odd, *((100 + i, t) for i, t in rows), (400, rows[0][1])])
    base = f"file://{tmp_path}"
    d.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(100 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    now = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, base)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns
        out.write.parquet(f"{base}/{name}")
        now = spark.read.parquet(f"{base}/{name}")
    assert now.where("NOT round_trip").isEmpty() and now.count() > 0
    assert spark.read.parquet(f"{base}/simhash near-dedup").where("doc_id = 400").isEmpty()


def test_mix_draws_what_the_tree_gives_each_shard(docs, monkeypatch):
    rng = random.Random(21)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 900))) for i in range(200)] + [(3, "w w"), (3, "x x"), (3, "x x"), (None, "w"), (7, None)]
    d = docs(rows)
    kept, own_split = {}, mixing.split

    def spy(quotas, shards, seed):
        kept["quotas"], kept["counts"] = quotas, own_split(quotas, shards, seed)
        return kept["counts"]

    monkeypatch.setattr(mixing, "split", spy)
    out = mixing.mix(d, shards=6).collect()
    sizes = {}
    for i, t in rows:
        sizes[f"s{(i or 0) % 3}"] = sizes.get(f"s{(i or 0) % 3}", 0) + len((t or "").split())
    goal = dict(zip(sorted(sizes), mixing.targets([sizes[k] for k in sorted(sizes)]), strict=True))
    of = lambda r: f"s{(r.doc_id or 0) % 3}"
    assert all(r.source_size == sizes[of(r)] and r.target == pytest.approx(goal[of(r)]) and r.taken == sum(x["last"] - x["first"] for x in r.draws) <= 2 * r.size for r in out)
    # each shard has exactly the blocks that the tree's counts give it, none twice
    seen = {(of(r), x["pass"], x["shard"], x["place"]) for r in out for x in r.draws}
    for k, source in enumerate(sorted(sizes)):
        for turn in range(3):
            assert [sum(1 for s in seen if s[:3] == (source, turn, shard)) for shard in range(6)] == kept["counts"][:, 3 * k + turn].tolist()
    for k, source in enumerate(sorted(sizes)):
        assert abs(sum(r.taken for r in out if of(r) == source) - goal[source]) <= 2 * mixing.BLOCK
    # the tree's counts decide what is taken, and the same ones give the same
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    taken = sorted(map(key, out))
    assert sorted(map(key, mixing.mix(d, shards=6).collect())) == taken

    def all_to_one(quotas, shards, seed):
        counts = np.zeros((shards, len(quotas)), "i8")
        counts[0] = quotas
        return counts

    monkeypatch.setattr(mixing, "split", all_to_one)
    assert sorted(map(key, mixing.mix(d, shards=6).collect())) != taken


def test_large_draws_are_hypergeometric():
    rng = np.random.default_rng(5)
    good, bad, n = 3 * 10**11, 7 * 10**11, 4 * 10**11
    got = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(30)], "f8")
    sd = (n * 0.3 * 0.7 * 0.6) ** 0.5
    assert abs(got.mean() - 0.3 * n) < 4 * sd / 30**0.5 and 0.6 < got.std() / sd < 1.5
    assert mixing.hypergeometric(rng, 10**12, 0, 5) == 5 and mixing.hypergeometric(rng, 1, 10**12, 10**12 + 1) == 1


def test_mix_of_many_sources(spark):
    d = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id) AS source", "'a b c' AS text", "1 AS _", "2 AS c0")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "MOST_CELLS", 3 * 3000 * 4)
        out = mixing.mix(d).select("taken").collect()
        assert len(out) == 3000 and max(r.taken for r in out) <= 6
        assert mixing.mixed_documents(d).columns == d.columns


def test_few_rows_are_verified():
    """Recall and the share of rows verified, with the query's own parameters, on vectors without clusters and with some."""
    rng = np.random.default_rng(8)
    for spread in (None, 0.8):
        x = rng.standard_normal((4096, 64))
        if spread:
            x = spread * x + 2 * rng.standard_normal((10, 64))[rng.integers(0, 10, 4096)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, asks = np.arange(4096), np.arange(0, 4096, 80)
        hits = list(collision_ann.Block(x, 1.0).candidates(x[asks], 20, ids, asks))
        score = x[asks] @ x.T
        score[np.arange(len(asks)), asks] = -9
        best = np.argsort(-score, axis=1)[:, :20]
        recall = np.mean([np.isin(b, h).mean() for b, h in zip(best, hits)])
        share = sum(map(len, hits)) / len(asks) / len(x)
        print(f"spread {spread}: recall {recall:.3f}, {share:.3f} of all rows verified")
        assert recall >= 0.9 and share < 0.1 and not any(a in h for a, h in zip(asks, hits))


def test_repeated_ids_leave_other_candidates(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((30, 8)).astype("f4").tolist()
    rows = [(0, x) for x in v[:24]] + [(1 + i, x) for i, x in enumerate(v[24:])]
    got = collision_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 1, k=20).collect()
    assert len(got) == 20 and {r.query_id for r in got} == {1}
    got = collision_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=20).collect()
    assert len(got) == 24 * 6 and {r.vec_id for r in got} == set(range(1, 7))


def test_clashing_columns_stay(spark, odd):
    names = ["more", "_t", "_b", "_w", "b_email", "w_ip", "base", "spans", "kept", "own", "new", "c0", "_", "gone_id", "gone_0", "tie", "chunk", "start", "key", "size", "shard", "place"]
    rows = [(i, t, "s") for i, t in [*odd, (50, "mail joe@site.org now " * 40)]]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", "text", "source", F.length("text").cast("long").alias("n_chars"), *(F.lit(f"own {n}").alias(n) for n in names))
    from graphloom.llm import bpe, simhash

    for out in (pii.redact(d), simhash.keep_one(d), mixing.mixed_documents(d), pii.find(d).drop("base", "spans"), bpe.code(d, decoded="round").drop("ids", "round")):
        kept = out.collect()
        assert kept and all(r[n] == f"own {n}" for r in kept for n in names if n in out.columns)
        assert [c for c in d.columns if c not in out.columns] in ([], ["base", "spans"])
    assert "joe" not in " ".join(r.text or "" for r in pii.redact(d).collect())


def test_training_rows_are_bounded(spark):
    d = spark.range(3000).selectExpr("7 AS doc_id", "concat('word', id, ' vile'  ) AS text").unionByName(spark.range(100, 140).selectExpr("id AS doc_id", "'a good day' AS text"))
    known = spark.createDataFrame([(7, 1, 1), *((i, 1, 0) for i in range(100, 140))], "doc_id long, quality int, toxic int")
    seen, own = [], toxicity.fit_chain
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "fit_chain", lambda x, y, *a: seen.append(len(y)) or own(x, y, *a))
        toxicity.train(d, known, most_rows=30)
        toxicity.train(d, known, most_rows=5000)
    assert seen == [30, 3040]


def test_chain_is_trained_on_out_of_fold_probabilities(monkeypatch):
    """With noise that a model can learn by heart, in-fold probabilities would look sure and out-of-fold ones don't."""
    rng = np.random.default_rng(4)
    n = 300
    y0, x = rng.random(n) < 0.5, (np.arange(n), np.arange(n), np.ones(n))  # a feature of its own for each document
    seen, own = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda x, n, size, before, y, **o: seen.append(before.copy()) or own(x, n, size, before, y, **o))
    models = toxicity.fit_chain(x, np.column_stack([y0, y0]).astype("f8"), np.arange(n) % 3, n)
    before = seen[-1][:, 0]
    in_fold = toxicity.odds(models[0].predict(x, n, np.zeros((n, 0))))
    assert ((in_fold > 0) == y0).mean() > 0.95 and abs(((before > np.median(before)) == y0).mean() - 0.5) < 0.2
    # brute force: each document's probability comes from a model fitted without its fold
    for k in range(3):
        keep = np.arange(n) % 3 != k
        m = own(toxicity.part(x, keep), int(keep.sum()), n, np.zeros((int(keep.sum()), 0)), y0[keep].astype("f8"))
        want = toxicity.odds(m.predict(toxicity.part(x, ~keep), int((~keep).sum()), np.zeros((int((~keep).sum()), 0))))
        assert np.allclose(before[~keep], want)


def test_sweep(spark):
    from graphloom.llm.common import sweep, written

    t = written(spark.range(3).toDF("i"), "some")
    assert t.count() == 3 and sweep(spark) and not sweep(spark)
