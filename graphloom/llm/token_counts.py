"""Token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Tier 1 is a compact hash table of frequent pre-tokens' lengths (in tokens), broadcast. It holds at most ``FREQUENT`` pre-tokens, which are
chosen by counts over every text of all documents, made in at most ``TASKS`` tasks that return ``TOP`` each; so the driver gets at most
TASKS x TOP entries whatever the input. The table only saves time: counts never depend on it. Tier 2 is a
cache in each worker, bounded by bytes and kept from task to task: pre-tokens that are in neither tier are encoded by the tokenizer's library,
each once, many at once.

Pre-tokens are the matches of the library's pattern. Where a text has characters that the pattern's engine here may class in another
way (other versions of Unicode), the library's own pre-tokenizer splits it; its pre-tokens go through the same tiers. Only texts that
hold a special token's string are encoded whole by the library.

Nulls and odd input: a null text counts as empty: 0 bytes, 0 tokens, not over the limit; repeated rows and null doc_ids
keep one row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, table

VOCABULARY = "byte_bpe_50k.json"
FREQUENT, LIMIT = 65_536, 512
#: The counts for tier 1: tasks, and entries that each task returns, from ``SUMMARY`` counters at most. Bytes of tier 2, and of text that is looked up at once.
TASKS, TOP, SUMMARY, CACHE, STEP = 256, 4_096, 65_536, 64 << 20, 4 << 20
#: Characters whose class (letter, number, white space, other) is stable over Unicode versions: up to U+024F, dashes and quotes, currency.
_PLAIN = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁞₠-₿]")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = [re.escape(x.content) for x in t.get_added_tokens_decoder().values()]
    return t, re.compile("|".join(special) if special else r"(?!)")


def _lengths(t, texts: list[str]) -> list[int]:
    return [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


@lru_cache(maxsize=2)
def splitter(path: str) -> Callable[[str], list[str]]:
    """The library's pre-tokens of a text."""
    own, match = tokenizer(path)[0].pre_tokenizer.pre_tokenize_str, regex.compile(public_tokenizers.PATTERN).findall
    return lambda x: [x[a:b] for _, (a, b) in own(x)] if _PLAIN.search(x) else match(x)


class Cache(dict):
    size = 0


class Tiers(dict):
    """Lengths of pre-tokens: tier 1, and what it lacks from the worker's cache."""

    def __init__(self, first: dict[str, int], cache: Cache):
        super().__init__(first)
        self.cache = cache

    def __missing__(self, piece: str) -> int:
        return self.cache[piece]

    def learn(self, pieces: set[str], t) -> None:
        """Encodes the pieces that neither tier has."""
        rest = pieces - self.keys()
        new = list(rest - self.cache.keys())
        if self.cache.size + sum(map(len, new)) * 2 + 150 * len(new) > CACHE:
            self.cache.clear()
            self.cache.size, new = 0, list(rest)
        self.cache.size += sum(map(len, new)) * 2 + 150 * len(new)
        self.cache.update(zip(new, _lengths(t, new), strict=True))


@lru_cache(maxsize=2)
def _cache(path: str) -> Cache:
    """Of this worker, for all its tasks."""
    return Cache()


def frequent(docs: DataFrame, path: str, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of all texts: at most FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(path), Counter()
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    counts.update(split(x.as_py()))
                    if len(counts) > 4 * SUMMARY:  # what is as rare as the first dropped loses that much, as in lossy counting
                        top = counts.most_common(SUMMARY + 1)
                        counts = Counter({c: n - top[-1][1] for c, n in top[:-1] if n > top[-1][1]})
        top = [(c, n) for c, n in counts.most_common(TOP) if len(c) <= 64 and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    counts: Counter = Counter()
    for r in docs.select(text).coalesce(TASKS).mapInArrow(run, "piece string, n long").collect():
        counts[r.piece] += r.n
    return [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]


def count(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    path = path or public_tokenizers.path(VOCABULARY)
    words = frequent(docs, path, text)
    first_tier = dict(zip(words, _lengths(tokenizer(path)[0], words), strict=True))
    spread = docs.sparkSession.sparkContext.broadcast(first_tier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (t, special), split, known = tokenizer(path), splitter(path), Tiers(spread.value, _cache(path))
        for whole in batches:
            for batch in steps(whole, 1, STEP):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                odd = [k for k, x in enumerate(texts) if special.search(x)]
                total = dict(zip(odd, _lengths(t, [texts[k] for k in odd]), strict=True))
                parts = [[] if k in total else split(x) for k, x in enumerate(texts)]
                known.learn(set(chain.from_iterable(parts)), t)
                n = [total[k] if k in total else sum(map(known.__getitem__, p)) for k, p in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
