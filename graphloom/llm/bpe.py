"""Byte-level BPE encoding and decoding, exact and in linear time.

Vocabulary bytes are mapped to Latin-1 text, so that one pyahocorasick automaton finds every token that starts at each byte
of a pre-token. Encoding takes the longest match at each place and backtracks to the next shorter match (or over the token
before) unless the two adjacent tokens are compatible, that is, unless merging by ranks would never have crossed or joined
them. Compatibility of a pair is worked out by undoing merges and memoised. A place from which no compatible continuation
exists is remembered, so each place is left behind once and the work is linear in the bytes. The result is the one sequence
of pairwise compatible tokens, which is what merging the lowest rank first gives.

Pre-tokens are the matches of a pattern, each encoded by itself; a worker keeps the ids of recent pre-tokens, and of
recent words with what is around them up to the next space, in caches bounded by bytes. ``code`` encodes and decodes in one pass, with
one worker and one vocabulary for each core.

Nulls and odd input: a null text counts as empty and has no tokens; null ids decode to nothing (empty bytes); an id outside
the vocabulary raises; repeated rows keep one result each; empty tables give empty results; all other columns stay, and
columns named like the results are replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, table
from .pretokens import chunks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of a worker's caches, in bytes and in pairs; a full one is emptied. Pre-tokens over LONG characters are not kept.
CHUNKS, PIECES, PAIRS, LONG = 32 << 20, 16 << 20, 100_000, 64
#: Bytes of text that are coded at a time, so that a batch of very long ones fits in memory.
STEP = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        reachable = set()
        for rank in sorted(self.tokens):  # lower ranks first: the halves of a token are known before it
            token = self.tokens[rank]
            last = self._last_merge(token, rank)
            if last:
                reachable.add(rank)
                self.halves[rank] = last
                if last != (rank, rank):
                    self.joins[last] = rank
        self.automaton = ahocorasick.Automaton()
        for rank in reachable:
            self.automaton.add_word(self.tokens[rank].decode("latin-1"), (len(self.tokens[rank]), rank))
        self.automaton.make_automaton()
        self.shorter = {rank: self._longest_proper_prefix(self.tokens[rank], reachable) for rank in reachable}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _longest_proper_prefix(self, token: bytes, reachable: set[int]) -> int | None:
        return next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) in reachable), None)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge ends in this one when its bytes are merged; itself twice if it is one byte; none if merging ends elsewhere."""
        if len(token) == 1:
            return rank, rank
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] >= rank:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        found = tuple(self.ranks.get(p) for p in parts)
        return found if None not in found else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether a followed by b stays as it is: undo merges, the later first, and see that none would have joined across."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        left, right, limit, ok = a, b, 1 << 60, None
        while ok is None:
            if self.joins.get((left, right), 1 << 60) < limit:
                ok = False
            elif left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    ok = True if right + 1 == limit else None
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    ok = True if left == limit else None
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest: list[int | None] = [None] * (size + 1)
        for end, (n, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n + 1] = rank  # ends ascend, so the last match of a start is its longest
        tokens, shorter, dead = self.tokens, self.shorter, bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            if token is None:  # nothing fits here: never come back, and shorten the token before
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
                token = shorter[token]
                continue
            end = at + len(tokens[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
            else:
                token = shorter[token]
        return out


class Held(dict):
    """A cache of str -> bytes that is emptied before its entries take more than ``most`` bytes."""

    def __init__(self, most: int):
        super().__init__()
        self.most = self.left = most

    def keep(self, key: str, ids: bytes) -> None:
        if len(key) > LONG:
            return
        size = 200 + 2 * len(key) + len(ids)  # the slot, two objects' heads, and what they hold
        if size > self.left:
            self.clear()
            self.left = self.most
        self[key] = ids
        self.left -= size


class Chunks(Held):
    """What follows a space, up to the next place where a pre-token must start -> its ids as int32 bytes; missing ones are encoded and kept."""

    def __init__(self, encoder: Encoder, pattern: str, times: int = 1):
        super().__init__(times * CHUNKS)
        self.encoder, self.split, self.pieces = encoder, regex.compile(pattern).findall, Held(times * PIECES)

    def ids(self, text: str) -> bytes:
        """The ids of a text's pre-tokens, by the pieces known so far."""
        out, pieces = [], self.pieces
        for piece in self.split(text):
            found = pieces.get(piece)
            if found is None:
                found = array("i", self.encoder.encode(piece.encode("utf-8"))).tobytes()
                pieces.keep(piece, found)
            out.append(found)
        return b"".join(out)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.ids(" " + chunk)
        self.keep(chunk, ids)
        return ids

    def text(self, text: str) -> bytes:
        first, *rest = chunks(text)
        return self.ids(first) + b"".join(map(self.__getitem__, rest))

    def bytes_of(self, ids: bytes) -> bytes:
        """The bytes that ids (int32 bytes) stand for."""
        return b"".join(map(self.encoder.tokens.__getitem__, array("i", ids)))


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str, times: int) -> Chunks:
    return Chunks(Encoder(read_ranks(path)), pattern, times)


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "i4")), type=pa.list_(pa.field("element", pa.int32(), False)))


IDS = T.ArrayType(T.IntegerType(), False)


def code(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", out: str = "ids", decoded: str | None = "decoded", keep_text: bool = True, times: int = 1) -> DataFrame:
    """docs with columns ``out`` array<int>, the ids of the whole text without special tokens, and ``decoded`` binary, the bytes that these ids
    stand for (None: left out). keep_text=False drops the text. times: the size of a worker's caches, in CHUNKS and PIECES."""
    path = path or public_tokenizers.path(VOCABULARY)
    new = [out, *([decoded] if decoded else [])]
    base = docs.drop(*({*new} - {text}))
    fields = [f for f in base.schema.fields if f.name not in new and (keep_text or f.name != text)]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in zip(new, (IDS, T.BinaryType())))])
    at, kept = base.columns.index(text), [base.columns.index(f.name) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker(path, pattern, times)
        for whole in batches:
            for batch in steps(whole, at, STEP):
                ids = [known.text(x.as_py()) if x.is_valid else b"" for x in batch.column(at)]
                arrays = [_lists(ids), *([pa.array(map(known.bytes_of, ids), pa.binary(), size=len(ids))] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *arrays], names=schema.names)

    return base.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs with a column ``out`` array<int>: the ids of the whole text. Without special tokens. keep_text=False drops the text."""
    return code(docs, path, pattern, text, out, None, keep_text)


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a column ``out`` binary: the bytes that the ids stand for."""
    path = path or public_tokenizers.path(VOCABULARY)
    base = docs.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.BinaryType())])
    at = base.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _tokens(path).__getitem__
        for batch in batches:
            texts = [b"".join(map(get, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return base.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False, times=3).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLES: dict[str, str] = {}
