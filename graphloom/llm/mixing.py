"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents one after another, form a stream that is cut into blocks of ``block`` words. A source's
target becomes an exact quota of block draws: whole passes over the source, then a part of one more. A binary tree over the
output shards splits the quotas of all sources and passes at each node by multivariate-hypergeometric draws, so every shard gets whole
counts that add up to the quotas exactly.

The blocks go down the same tree: a node permutes those it has by a key of its own and hands to its left child as many as the left quotas
ask for, with its part of the blocks that are not drawn, and the rest to its right child. At the end each shard permutes its blocks and
draws the first ones, as many as its quota; so shards draw disjoint blocks, and what is drawn follows from the tree's counts. A shard
orders its draws by a keyed hash.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` of all words; a target stops
at ``most`` times its source's words and the excess is shared again by weight among the others until none is above.

Scale. A block's way down the tree is a function of its number and the counts, so drawing needs no shuffle. Stream offsets are
prefix sums at three levels: a source is dealt to chunks of about ``CHUNK`` documents by hash, so no task orders a hot source. Shards
grow in number with the words. The driver holds one row per source, and shards x sources x passes counts; the shards are so few that
these are at most ``MOST_CELLS``.

Nulls and odd input: a null text has 0 words; a null source is a source of its own, after all others; documents without words
are never drawn and take 0; null or repeated doc_ids are rows of their own, repeated rows too; an empty table gives an empty
result; further columns are kept by ``mixed_documents`` only, whatever their names. The same input and seed give the same mix: rows
of one doc_id come in the order of their sizes and the hashes of their texts, and rows equal in these are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, cut, table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, CHUNK, SHARDS, SHARD_WORDS, MOST_CELLS = 128, 256, 64, 64_000_000, 5_000_000
_DRAWS = "array<struct<shard:int,place:bigint,pass:int,first:bigint,last:bigint>>"


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """The target of each source, whose sizes come in source order."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        out_now = {i: left * weights[i % len(weights)] / total for i in open_}
        above = [i for i in open_ if out_now[i] > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = out_now[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. Beyond the generator's range by inversion over all counts within 12 standard
    deviations, whose probabilities come from their exact ratios."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 64 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5)
    first = max(low, mode - reach)
    k = first + np.arange(min(high, mode + reach) - first, dtype="f8")
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(cdf, rng.random() * cdf[-1], "right"))


def split(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources block counts whose columns sum to the quotas; each shard's total is within one block of the others'."""
    if shards * max(1, len(quotas)) > MOST_CELLS:
        raise ValueError(f"{shards} shards of {len(quotas)} sources are more than {MOST_CELLS} counts; take fewer shards")
    out = np.zeros((shards, len(quotas)), "i8")

    def node(first: int, last: int, own: list[int]) -> None:
        if last - first == 1:
            out[first] = own
            return
        rng = np.random.default_rng([seed, first, last])
        middle, total = (first + last) // 2, sum(own)
        # the left child's room: shards of equal totals, the remainder to the first ones
        room = sum(sum(own) // (last - first) + (s - first < total % (last - first)) for s in range(first, middle))
        left, rest = [], total
        for q in own:
            rest -= q
            left.append(hypergeometric(rng, q, rest, room))
            room -= left[-1]
        node(first, middle, left)
        node(middle, last, [q - x for q, x in zip(own, left, strict=True)])

    if len(quotas):
        node(0, shards, [int(q) for q in quotas])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of block x among n in the permutation of this key (elementwise): four Feistel rounds, walked until below n."""
    half = np.ceil(np.log2(np.maximum(n, 2).astype("f8") + 1) / 2).astype("u8")
    mask, x, n, key = (np.uint64(1) << half) - np.uint64(1), x.astype("u8").copy(), n.astype("u8"), key.astype("u8")
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(4):
            left, right = right, left ^ (_mixed(right + k + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype("i8")


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def drawn(b: np.ndarray, column: np.ndarray, n: np.ndarray, upto: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, place, drawn) of block b of a column's n blocks: its way down the tree. upto[s] are the quotas of the shards before s, by column."""
    first, last = np.zeros(len(b), "i8"), np.full(len(b), len(upto) - 1)
    place, pool = b.astype("i8"), n.astype("i8").copy()
    node = lambda w: _mixed(keys[column[w]] + _mixed((first[w].astype("u8") << np.uint64(32)) + last[w].astype("u8")))
    while len(way := np.flatnonzero(last - first > 1)):
        place[way] = permuted(place[way], pool[way], node(way))
        c, lo, hi = column[way], first[way], last[way]
        middle = (lo + hi) // 2
        quota, left = upto[hi, c] - upto[lo, c], upto[middle, c] - upto[lo, c]
        room = left + (pool[way] - quota) * (middle - lo) // (hi - lo)  # blocks of the left child: its draws and its part of the others
        right = place[way] >= room
        place[way] -= np.where(right, room, 0)
        pool[way] = np.where(right, pool[way] - room, room)
        first[way], last[way] = np.where(right, middle, lo), np.where(right, hi, middle)
    every = np.arange(len(b))
    place = permuted(place, pool, node(every)) if len(b) else place
    return first, place, place < upto[last, column] - upto[first, column]


def mix(docs: DataFrame, keep: Sequence[str] = (), text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shards: int | None = None, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, the columns in ``keep`` as a struct ``kept``, size, source_size, target, taken, draws.

    ``draws`` has, for each block that the mix takes from the document, the shard, the place in the shard's order, the pass,
    and the words [first, last) of the document. shards: by default one for ``SHARD_WORDS`` words of the mix, ``SHARDS`` at least.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source))).alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text)).alias("tie"),
        F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep))).alias("kept"),
    )
    if not keep:
        base = cut(base)  # small rows; with texts they are counted again instead
    found = base.groupBy("key").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()  # a row per source
    found = sorted(found, key=lambda r: (r.key == "n", r.key))
    sizes = [r.words for r in found]
    goals = targets(sizes, weights, share, most)
    n = [-(-w // block) for w in sizes]
    passes = [min(most, int(g // w)) if w else 0 for g, w in zip(goals, sizes, strict=True)]
    rest = [0 if p >= most or not w else min(k, round((g - p * w) / block)) for g, w, p, k in zip(goals, sizes, passes, n, strict=True)]
    turns = most + 1
    quotas = [k if turn < p else r if turn == p else 0 for p, k, r in zip(passes, n, rest, strict=True) for turn in range(turns)]  # by source, then pass
    shards = shards or max(SHARDS, -(-sum(quotas) * block // SHARD_WORDS))
    shards = max(1, min(shards, MOST_CELLS // max(1, len(quotas))))
    counts = split(quotas, shards, seed)
    plan = docs.sparkSession.sparkContext.broadcast({
        "at": {r.key: i for i, r in enumerate(found)}, "n": np.array(n, "i8"), "upto": np.concatenate([np.zeros((1, len(quotas)), "i8"), np.cumsum(counts, axis=0)]), "some": np.array(quotas, "i8") > 0,
        "keys": np.array([_key(seed, r.key, turn) for r in found for turn in range(turns)], "u8"), "goals": np.array(goals, "f8"), "sizes": np.array(sizes, "i8"),
    })

    chunks = max(1, -(-sum(r.rows for r in found) // CHUNK))
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("key", "doc_id"), F.lit(chunks)))
    upto = lambda by, order: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = dealt.groupBy("key", "chunk").agg(F.sum("size").alias("words")).withColumn("range", F.expr(f"chunk div {CHUNK}"))
    large = small.groupBy("key", "range").agg(F.sum("words").alias("words")).select("key", "range", upto(["key"], "range").alias("before"))
    offsets = small.select("key", "range", "chunk", upto(["key", "range"], "chunk").alias("within")).join(large, ["key", "range"]).select("key", "chunk", (F.col("before") + F.col("within")).alias("offset"))
    within = Window.partitionBy("key", "chunk").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["key", "chunk"])
    placed = placed.select("doc_id", "key", "size", (F.col("start") + F.col("offset")).alias("start"), "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            src = np.array([p["at"][k] for k in batch.column(1).to_pylist()], "i8")
            size, start = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            first, last = start // block, np.where(size > 0, (start + size - 1) // block, start // block - 1)
            number = last - first + 1
            row = np.repeat(np.arange(len(src)), number)
            b = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + first[row]
            low, high = np.maximum(b * block, start[row]) - start[row], np.minimum((b + 1) * block, (start + size)[row]) - start[row]
            cols = []
            for turn in range(turns):
                some = np.flatnonzero(p["some"][src[row] * turns + turn])
                column = src[row[some]] * turns + turn
                shard, place, use = drawn(b[some], column, p["n"][src[row[some]]], p["upto"], p["keys"])
                own = some[use]
                order = _mixed(place[use].astype("u8") + p["keys"][column[use]] + shard[use].astype("u8") * np.uint64(0x9E3779B97F4A7C15)).view("i8")
                cols.append(np.stack([row[own], shard[use], order, np.full(len(own), turn), low[own], high[own]]))
            row, shard, place, turn, low, high = np.concatenate(cols, axis=1)
            order = np.lexsort((low, turn, row))
            row, shard, place, turn, low, high = (x[order] for x in (row, shard, place, turn, low, high))
            taken = np.bincount(row, weights=high - low, minlength=len(src)).astype("i8")
            ends_ = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(src)))])
            draws = pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), pa.StructArray.from_arrays([pa.array(shard, pa.int32()), pa.array(place), pa.array(turn, pa.int32()), pa.array(low), pa.array(high)], ["shard", "place", "pass", "first", "last"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(2), pa.array(p["sizes"][src]), pa.array(p["goals"][src]), pa.array(taken), draws], ["doc_id", "kept", "size", "source_size", "target", "taken", "draws"])

    schema = T.StructType([placed.schema["doc_id"], placed.schema["kept"], *T._parse_datatype_string(f"size long, source_size long, target double, taken long, draws {_DRAWS}").fields])
    return placed.mapInArrow(run, schema)


def shard_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row per block piece, its shards together and each in its own order."""
    rows = mixed.select("doc_id", F.explode("draws").alias("d")).select("d.shard", "d.place", "doc_id", "d.pass", "d.first", "d.last")
    return rows.repartition("shard").sortWithinPartitions("shard", "place", "doc_id", "first")


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs as the mix takes them, in the columns of docs: a row per document and pass in which any of it is taken.

    A pass that takes the whole document repeats its row as it is; one that takes a part has the words taken, joined by single spaces.
    n_chars, if there, is counted again for a part. A row goes to the shard of its first draw, and each shard is shuffled locally, by the
    places of these draws.
    """
    m = mix(docs, keep=docs.columns, text=text, **options)
    at = {c: f"kept.c{k}" for k, c in enumerate(docs.columns)}
    per = m.select("kept", "size", F.explode(F.expr("transform(array_distinct(draws.pass), p -> filter(draws, d -> d.pass = p))")).alias("own"))
    part = F.expr(f"array_join(flatten(transform(own, d -> slice(regexp_extract_all({at[text]}, r'{WORD}', 0), cast(d.first + 1 as int), cast(d.last - d.first as int)))), ' ')")
    whole = F.expr("aggregate(own, 0L, (s, d) -> s + d.last - d.first)") == F.col("size")
    new = per.select("kept", F.col("own")[0]["shard"].alias("shard"), F.col("own")[0]["place"].alias("place"), whole.alias("whole"), F.when(whole, F.col(at[text])).otherwise(part).alias("new"))
    new = new.repartition("shard").sortWithinPartitions("shard", "place")
    of = {text: F.col("new")} | ({"n_chars": F.when(F.col("whole"), F.col(at["n_chars"])).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return new.select(*(of.get(c, F.col(at[c])).alias(c) for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
