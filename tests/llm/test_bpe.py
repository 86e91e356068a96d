import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, token_counts

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def known():
    return bpe.Chunks(bpe.Encoder(bpe.read_ranks(P.path(bpe.VOCABULARY))), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})


def texts():
    rng = random.Random(3)
    out = ["", " ", "  lead", "tail  ", "a\n\n b", "a" * 5000, " " * 3000, "é" * 999, "\x1c a \x1c b", "<|endoftext|> hi", "don't we'll"]
    out += ["".join(rng.choice(" \n\t ab1,.'s　é中😀") for _ in range(60)) for _ in range(2000)]
    return out + ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(500)) for _ in range(20)]


def test_equals_library(known, library):
    for t in texts():
        assert np.frombuffer(known.text(t), "i4").tolist() == library.encode_ordinary(t)


def test_small_caches(library, monkeypatch):
    for name in ("CHUNKS", "PIECES", "PAIRS"):
        monkeypatch.setattr(bpe, name, 3)
    small = bpe.Chunks(bpe.Encoder(bpe.read_ranks(P.path(bpe.VOCABULARY))), P.PATTERN)
    for t in texts()[:200]:
        assert np.frombuffer(small.text(t), "i4").tolist() == library.encode_ordinary(t)


def test_linear_time(known):
    assert len(known.encoder.encode(b"ab" * 100_000)) > 1000


def test_round_trip(spark, docs, odd):
    d = docs(odd)
    out = bpe.decode(bpe.encode(d))
    assert out.count() == len(odd) and set(d.columns) < set(out.columns)
    assert out.where(F.col("decoded") != F.coalesce(F.col("text").cast("binary"), F.lit(b""))).isEmpty()
    assert bpe.decode(bpe.encode(docs([]).limit(0))).isEmpty()
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded == b""


def test_token_counts(spark, docs, odd):
    t, _ = token_counts.tokenizer(P.path(token_counts.VOCABULARY))
    rows = [*odd, *((100 + i, x) for i, x in enumerate(texts())), (50, "a<|endoftext|>b <|endoftext|>")]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(docs(rows)).collect())
    want = sorted((i or -1, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 512) for i, x in rows)
    assert got == want
    assert token_counts.count(docs([]).limit(0)).isEmpty()


def test_frequent_pretokens_come_from_every_text(spark):
    """Words that stand in one of 30,000 texts each, but often there, are all among the frequent ones."""
    word = F.concat(F.lit(" zyxw"), F.char(F.lit(97) + F.expr("id div 1500")))
    many = spark.range(30_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.expr("id % 1500 = 7"), F.repeat(word, 500)).otherwise("a b").alias("text"))
    assert {f" zyxw{chr(97 + i)}" for i in range(20)} <= set(token_counts.frequent(many, P.path(token_counts.VOCABULARY)))


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 20_000)
    known = bpe.Chunks(bpe.Encoder(bpe.read_ranks(P.path(bpe.VOCABULARY))), P.PATTERN)
    for i in range(2000):
        known.text(f"a word{i} " + "é" * (i % 60))
        assert sum(200 + 2 * len(k) + len(v) for k, v in known.items()) <= 20_000 and len(known) > 0


def test_query_digests(spark, library, docs, odd, tmp_path):
    import hashlib

    rows = [*odd, *((100 + i, x) for i, x in enumerate(texts()[:300]))]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_byte_bpe(spark, str(tmp_path)).collect())
    want = []
    for i, x in rows:
        ids = library.encode_ordinary(x or "")
        want.append((i or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_tiers_hold_all_alphabets(monkeypatch):
    path = P.path(token_counts.VOCABULARY)
    t, _ = token_counts.tokenizer(path)
    rows = ["привет мир, как дела мир", "你好 世界 你好", "😀 😀 ok 😀", "γειά σου κόσμε", "naïve café", "a  b c\n\n d", "ⅷ ١٢٣ ꙮ"] * 3
    asked = []
    known = token_counts.Tiers({}, token_counts.Cache())
    own = token_counts._lengths
    monkeypatch.setattr(token_counts, "_lengths", lambda t, x: asked.extend(x) or own(t, x))
    for x in rows:
        pieces = token_counts.splitter(path)(x)
        known.learn(set(pieces), t)
        assert "".join(pieces) == x and sum(map(known.__getitem__, pieces)) == len(t.encode(x, add_special_tokens=False))
    assert len(asked) == len(set(asked)) and not set(asked) & set(rows)  # every pre-token once, no whole text
    monkeypatch.setattr(token_counts, "CACHE", 2_000)
    for x in rows:
        known.learn(set(p := token_counts.splitter(path)(x)), t)
        assert known.cache.size <= 4_000 and sum(map(known.__getitem__, p)) == len(t.encode(x, add_special_tokens=False))


def test_no_pre_token_is_shuffled(spark, docs, odd, capsys):
    out = token_counts.count(docs(odd))
    out.explain("formatted")
    assert "Exchange" not in capsys.readouterr().out
    assert len(token_counts.frequent(docs([(i, "a b c " * i) for i in range(50)]), P.path(token_counts.VOCABULARY))) <= token_counts.FREQUENT
