import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bwt_dedup, cap_filters, simhash
from graphloom.llm.common import components, local_labels


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5001 + i) for i in range(300)]
    label = {}
    ids = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(ids)}
    for x, k in zip(ids, local_labels(len(ids), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))):
        label[x] = ids[k]
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def fingerprint(text, k=3):
    import xxhash

    words = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(spark, docs, odd):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(30)]
    rows = list(odd)
    for i in range(300):
        t = list(base[i % 30])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(200)] = rng.choice(words)
        rows.append((100 + i, " ".join(t)))
    got = simhash.near_duplicates(docs(rows)).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((i, fingerprint(t or "")) for i, t in rows)
    ids = [(i, fingerprint(t or "")) for i, t in rows if i is not None]
    a, b = zip(*[(x, y) for x in range(len(ids)) for y in range(x) if (ids[x][1] ^ ids[y][1]).bit_count() <= 3])
    label = local_labels(len(ids), np.array(a), np.array(b))
    least = {}
    for (i, _), k in zip(ids, label):
        least[k] = min(least.get(k, i), i)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(i, least[k]) for (i, _), k in zip(ids, label)] + [(None, None)])


def test_pigeonring_keeps_all_close_pairs(monkeypatch, spark):
    rng = random.Random(3)
    reps = []
    for i in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        reps += [(np.uint64(x).astype("i8").item(), 2 * i), (np.uint64(y).astype("i8").item(), 2 * i + 1)]
    monkeypatch.setattr(simhash, "CELL", 2)  # every shared key is dealt as chunks
    found = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame(reps, "fp long, rep long")).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(200)} <= found


def test_keep_one(docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    text = [rng.choice(words) for _ in range(400)]
    near = list(text)
    near[200] = "changed"
    other = [rng.choice(words) for _ in range(400)]
    d = docs([(3, " ".join(text)), (4, " ".join(text)), (5, " ".join(near)), (6, " ".join(other)), (None, " ".join(text))])
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {None, 3, 6} <= ids and 4 not in ids


def kept_by_brute_force(rows, least=0.8):
    """Ids that stay: in the order of ids, a document goes if any of its texts is alike any text of one that stays."""
    of = {}
    for i, t in rows:
        words = (t or "").lower().split()
        of.setdefault(i, []).append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    alike = lambda a, b: len(a & b) >= least * len(a | b)
    stay = []
    for i in sorted(x for x in of if x is not None):
        if not any(alike(a, b) for j in stay for a in of[i] for b in of[j]):
            stay.append(i)
    return set(stay)


def test_keep_one_finds_near_copies_at_the_threshold(docs, odd):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    rows = list(odd)
    for i in range(60):  # two to six scattered words of 300 changed: similarities of about 0.82 to 0.94, far over 3 bits
        text = [rng.choice(words) for _ in range(300)]
        near = list(text)
        for k in rng.sample(range(10, 290), 2 + i % 5):
            near[k] = "changed"
        rows += [(100 + 2 * i, " ".join(text)), (101 + 2 * i, " ".join(near))]
    stay = kept_by_brute_force(rows)
    assert not {101 + 2 * i for i in range(60)} & stay
    assert {r.doc_id for r in simhash.keep_one(docs(rows)).collect()} == stay | {None}


def test_keep_one_settles_groups_joined_by_a_chain(docs):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(2000)]
    text = [rng.choice(words) for _ in range(300)]

    def changed(n, at=0):
        return " ".join("changed" if (k - at) % 20 == 10 and (k - at) // 20 in range(n) else w for k, w in enumerate(text))

    rows = [(1, changed(8))] + [(2 + i, changed(4)) for i in range(5)] + [(20 + i, " ".join(text)) for i in range(30)] + [(60, changed(1)), (61, changed(15))]
    stay = kept_by_brute_force(rows)
    assert len(stay & set(range(20, 50))) <= 1
    assert {r.doc_id for r in simhash.keep_one(docs(rows)).collect()} == stay


def test_cap_filters_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 64)).astype("f4")
    near = np.concatenate([x[i % 20][None] + 0.12 * rng.standard_normal((1, 64)).astype("f4") for i in range(200)])
    every = np.concatenate([x, near, x[:10], 3 * x[10:15]])
    label = [i % 2 for i in range(300)] + [i % 20 % 2 for i in range(200)] + [i % 2 for i in range(15)]
    rows = [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(every, label))]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [1.0, None], 1), (904, [float("nan")] * 64, 1), (905, x[0].tolist(), None), (None, x[0].tolist(), 0), (906, [float("inf")] * 64, 0), (907, [1.0] * 3, 0)]
    schema = "vec_id long, embedding array<float>, label int"
    u = every.astype("f8") / np.linalg.norm(every.astype("f8"), axis=1, keepdims=True)
    hit = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    component = local_labels(len(u), a, b)
    got = {r.vec_id: r for r in cap_filters.near_duplicates(spark.createDataFrame(rows + odd, schema).withColumn("filters", F.lit(0)).withColumn("cid", F.lit("x"))).collect()}
    assert len(got) == len(rows) + len(odd)
    for i in range(len(u)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum(), component[i], component[i] == i)
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert cap_filters.near_duplicates(spark.createDataFrame([], schema)).isEmpty()


def test_cap_filters_large_cells(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "CELL", 20)
    rng = np.random.default_rng(6)
    x = rng.standard_normal(64) + 0.01 * rng.standard_normal((150, 64))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def brute_repeats(docs, w=50):
    first = {}
    for i, t in docs:
        for k in range(len(t) - w + 1 if i is not None else 0):
            first[t[k : k + w]] = min(first.get(t[k : k + w], i), i)
    out = []
    for i, t in docs:
        cover = bytearray(len(t))
        for k in range(len(t) - w + 1 if i is not None else 0):
            if first[t[k : k + w]] < i:
                cover[k : k + w] = b"\1" * w
        runs = sum(cover[k] and (k == 0 or not cover[k - 1]) for k in range(len(t)))
        out.append((i, len(t), sum(cover), runs, hashlib.sha256(bytes(c for c, x in zip(t, cover) if not x)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_bwt_equals_brute_force(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(bwt_dedup, "SHARD", shard)
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    piece = lambda: base[(s := rng.randrange(1900)) : s + rng.randrange(1, 160)] if rng.random() < 0.5 else "".join(rng.choice("abé \x00") for _ in range(rng.randrange(80)))
    rows = [(i, "".join(piece() for _ in range(rng.randrange(6)))) for i in range(150)]
    rows += [(500, "a" * 3000), (501, "a" * 200), (502, "ab" * 400), (503, None), (504, ""), (None, base), (7, base[:300]), (7, base[100:500]), (505, base), (505, base), (506, "x" * 49)]
    got = Counter(tuple(r)[:5] for r in bwt_dedup.repeats(docs(rows)).collect())
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in rows])


def test_bwt_empty(docs):
    assert bwt_dedup.repeats(docs([]).limit(0)).isEmpty()


def test_intervals_equal_suffix_order():
    rng = random.Random(8)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(6, 40))).encode() for _ in range(60)]
    shards, place = [], []
    for part in (strings[:20], strings[20:45], strings[45:]):
        text = np.frombuffer(b"".join(s + b"\xff" for s in part), "u1")
        shards.append(bwt_dedup.Shard(text, 7))
        whole = text.tobytes()
        place += [whole[p : p + 6] for p in shards[-1].order]
    rows, block = bwt_dedup.intervals(shards, 6)
    seen = {}
    for r, b in zip(rows, block):
        assert seen.setdefault(b, place[r]) == place[r]
    count = Counter(s[k : k + 6] for s in strings for k in range(len(s) - 5))
    assert Counter(place[r] for r in rows) == Counter({s: n for s, n in count.items() if n > 1})


def test_wide_fingerprints_find_pairs_at_the_threshold():
    """Recall of the chains at similarities of 0.8 to 0.85, with edits scattered and in one place."""
    rng = np.random.default_rng(12)
    found = []
    for i in range(400):
        n, share = 400, 0.8 + 0.05 * rng.random()
        lost = round(n * (1 - share) / (1 + share))
        a, b = rng.integers(0, 1 << 63, n, "u8"), rng.integers(0, 1 << 63, lost, "u8")
        prints = np.stack([simhash.wide_fingerprint(a), simhash.wide_fingerprint(np.r_[a[lost:], b])])
        cell, chain = simhash.ring(prints)
        found.append(((cell[0] == cell[1]) & simhash.within(chain[0] ^ chain[1]) & simhash.begins(chain[0] ^ chain[1], cell[0].view("i8"))).any() and np.bitwise_count(prints[0] ^ prints[1]).sum() <= simhash.MOST_BITS)
    assert np.mean(found) >= 0.93
    same = np.repeat(simhash.wide_fingerprint(rng.integers(0, 1 << 63, 50, "u8"))[None], 2, axis=0)
    cell, chain = simhash.ring(same)
    assert ((cell[0] == cell[1]) & simhash.begins(chain[0] ^ chain[1], cell[0].view("i8"))).any()


def test_keep_one_deals_hot_cells(docs, monkeypatch):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(3000)]
    text = [rng.choice(words) for _ in range(200)]
    rows = [(i, " ".join([*text, f"tail{i}"])) for i in range(1, 301)]  # one group of unlike texts, alike one another
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(100)]
    monkeypatch.setattr(simhash, "CELL", 16)
    monkeypatch.setattr(simhash, "SAMPLE", 4)
    assert {r.doc_id for r in simhash.keep_one(docs(rows)).collect()} == {1} | {1000 + i for i in range(100)}


def test_keep_one_of_nothing(docs):
    assert simhash.keep_one(docs([]).limit(0)).isEmpty()
    assert simhash.near_duplicates(docs([]).limit(0)).isEmpty()
    d = docs([(1, "a b c"), (2, "a b c")]).withColumn("gone_0", F.lit(5)).withColumn("gone_id", F.lit(6))
    assert [(r.doc_id, r.gone_0) for r in simhash.keep_one(d).collect()] == [(1, 5)]


def test_transforms_carry_the_merge(monkeypatch):
    """The merge of shards that are not in suffix order goes wrong; in order, their transforms give back the text."""
    rng = random.Random(18)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(6, 40))).encode() for _ in range(60)]
    texts = [np.frombuffer(b"".join(s + b"\xff" for s in part), "u1") for part in (strings[:20], strings[20:45], strings[45:])]
    count = Counter(s[k : k + 6] for s in strings for k in range(len(s) - 5))
    want = Counter({s: n for s, n in count.items() if n > 1})

    def found(shards):
        whole = [t.tobytes() for t in texts]
        place = [w[p : p + 6] for w, s in zip(whole, shards) for p in s.order]
        rows, block = bwt_dedup.intervals(shards, 6)
        same = {}
        return Counter(place[r] for r in rows), all(same.setdefault(b, place[r]) == place[r] for r, b in zip(rows, block))

    shards = [bwt_dedup.Shard(t) for t in texts]
    assert found(shards) == (want, True)
    for t, s in zip(texts, shards):
        suffixes = [t.tobytes()[p:].split(b"\xff")[0] + b"\xff" for p in s.order]
        assert suffixes == sorted(suffixes)
    for t, s in zip(texts, shards):
        s.order = np.arange(len(t), dtype="i4")
        s.before = t[s.order - 1]
    assert found(shards) != (want, True)


@pytest.mark.parametrize("hot", [2, 1000])
def test_bwt_passage_in_every_document(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(bwt_dedup, "HOT", hot)
    monkeypatch.setattr(bwt_dedup, "SAMPLE", 2)
    monkeypatch.setattr(bwt_dedup, "FLUSH", 40_000)
    rng = random.Random(19)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    word = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(i, word(rng.randrange(200)) + passage + word(rng.randrange(200))) for i in rng.sample(range(1000), 300)]
    rows += [(2000, passage[:60] + passage[:60]), (2001, passage[10:70]), (3, passage), (3, passage + "tail"), (None, passage)]
    got = Counter(tuple(r)[:5] for r in bwt_dedup.repeats(docs(rows)).collect())
    assert got == brute_repeats([(i, t.encode()) for i, t in rows])
