"""Approximate nearest neighbours by collision-counting hashing, for the largest inner products.

Reduction. Vectors get one more component that brings all to the largest length, queries get a zero there, so that the largest
inner product is the nearest neighbour.

Index. Each data block keeps, for each of ``PROJECTIONS`` random directions (orthogonal in groups), its vectors' projections as one
sorted array, cut into ``BUCKETS`` buckets. A query opens windows centred on its own projections, each up to the ends of its buckets;
virtual rehashing widens all windows by the factor ``WIDEN`` at a time. Widening stops once ``VERIFY`` of a block's vectors and ``LEAST`` more (or all there are) lie in at least
``COLLISIONS`` of the windows. Of these, the vectors whose collisions exceed the threshold that leaves so many are verified by their inner
product in double precision, summed in the order of the components; every row is indexed.

Scale. Rows and queries are dealt to blocks of bounded size; a cell, one query block against one data block, fits one task and
returns k rows for each query, and a window per query merges its cells. Arrays are sorted again in each cell, which is a sixth of its
work. Every query meets every block: where vectors have no clusters, windows that hold the neighbours hold most rows of each projection,
so a join of windows with sorted arrays over the whole table would move more than the table for each query.

Nulls and odd input: vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, take no
part; vectors of another length than the query's are no candidates; a query's own row is every row of its vec_id, and repeated
equal query rows are one query; fewer than k candidates are all returned (windows widen until all are in); ties go to the smaller
vec_id; repeated rows are candidates each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cap_filters import usable
from .common import cut, table, whole_runs

PROJECTIONS, COLLISIONS, WIDEN, START, VERIFY, LEAST, BLOCK, BUCKETS, SEED = 192, 0.8, 1.15, 0.12, 0.04, 80, 4096, 128, 5


@lru_cache(maxsize=8)
def directions(size: int) -> np.ndarray:
    """size x PROJECTIONS."""
    rng = np.random.default_rng([SEED, size])
    groups = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-PROJECTIONS // size))]
    return np.concatenate(groups, axis=1)[:, :PROJECTIONS]


class Block:
    """Sorted projections of the vectors of one block, whose longest possible length is ``longest``."""

    def __init__(self, x: np.ndarray, longest: float):
        self.x, self.longest = x, longest
        self.turn = directions(x.shape[1] + 1)
        more = np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(axis=1)))
        places = (np.column_stack([x, more]) @ self.turn).T
        order = np.argsort(places, axis=1, kind="stable")
        # each sorted array is cut into ``BUCKETS`` buckets: where they begin (the arrays far apart, so that one search serves all), and
        # for each beginning the vectors before it as bits
        n, m = len(x), len(places)
        step = max(1, n // BUCKETS)
        begin = np.arange(0, n, step)
        self.apart = 8 * longest * np.arange(m)
        self.edges = (np.take_along_axis(places, order[:, begin], axis=1) + self.apart[:, None]).ravel()
        self.first = (len(begin) + 1) * np.arange(m)
        rank = np.empty(n, "i4")
        self.before = np.empty((m, len(begin) + 1, -(-n // 8)), "u1")
        for j in range(m):
            rank[order[j]] = np.arange(n)
            self.before[j] = np.packbits(rank < np.append(begin, n)[:, None], axis=1)
        self.before = self.before.reshape(m * (len(begin) + 1), -1)

    def collisions(self, centre: np.ndarray, half: float) -> np.ndarray:
        """The number of windows, one around the centre in each sorted array and up to the ends of its buckets, that each vector lies in."""
        reach, m = 3 * self.longest, len(centre)
        ends = np.searchsorted(self.edges, np.concatenate([np.maximum(centre - half, -reach) + self.apart, np.minimum(centre + half, reach) + self.apart]), "right")
        low, high = ends.reshape(2, -1) + np.arange(m)  # of the bits: one beginning more than edges in each array
        inside = self.before[np.maximum(low - 1, self.first)] ^ self.before[high]
        return np.add.reduce(np.unpackbits(inside, axis=1, count=len(self.x)), axis=0, dtype="u1")

    def candidates(self, queries: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
        """For each query, the vectors with the most collisions among those in enough of its windows, without those of its own id."""
        enough, budget = int(np.ceil(COLLISIONS * len(self.first))), max(k, int(np.ceil(VERIFY * len(self.x))) + LEAST)
        scale = self.longest / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
        centres = np.column_stack([queries * scale, np.zeros(len(queries))]) @ self.turn
        level = 0
        for q in range(len(queries)):
            other = ids != own[q]
            wanted = min(int(other.sum()), budget)

            def hits(level: int) -> tuple[np.ndarray, np.ndarray]:
                counts = self.collisions(centres[q], START * self.longest * WIDEN**level)
                return np.flatnonzero((counts >= enough) & other), counts

            # the first level of rehashing with candidates enough, looked for from the last query's on
            hit, counts = hits(level)
            if len(hit) >= wanted:
                while level > 0 and len((less := hits(level - 1))[0]) >= wanted:
                    (hit, counts), level = less, level - 1
            while len(hit) < wanted:
                level += 1
                hit, counts = hits(level)
            if len(hit) > wanted > 0:
                hit = hit[counts[hit] >= np.partition(counts[hit], len(hit) - wanted)[len(hit) - wanted]]
            yield hit


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "cell", 1):
            cell, qid, vec_id, longest = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "qid", "vec_id", "longest"))
            column = t.column("embedding").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            sizes, flat, starts = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype("f8"), np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            places = np.r_[0, np.cumsum(sizes)]
            for first, last in zip(starts, [*starts[1:], len(cell)]):
                x = flat[places[first] : places[last]].reshape(last - first, sizes[first])
                data, asks = np.flatnonzero(qid[first:last] < 0), np.flatnonzero(qid[first:last] >= 0)
                if not len(data) or not len(asks):
                    continue
                block, ids, queries = Block(x[data], float(longest[first])), vec_id[first:last][data], x[asks]
                out = [[], [], [], []]
                own_ids = vec_id[first:last][asks]
                for q, (own, hit) in enumerate(zip(own_ids, block.candidates(queries, k, ids, own_ids), strict=True)):
                    rough = block.x[hit] @ queries[q]
                    if len(hit) > k + 8:
                        hit = hit[rough >= np.partition(rough, len(rough) - k - 8)[len(rough) - k - 8]]
                    score = np.zeros(len(hit))
                    for c in range(x.shape[1]):  # summed in the order of the components
                        score += block.x[hit, c] * queries[q, c]
                    best = np.lexsort((ids[hit], -score))[:k]
                    out[0].append(np.full(len(best), qid[first:last][asks[q]]))
                    out[1].append(np.full(len(best), own))
                    out[2].append(ids[hit][best])
                    out[3].append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["qid", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of vectors(vec_id, embedding) that the condition ``queries`` selects, against all rows."""
    base = cut(vectors.where("vec_id IS NOT NULL").where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")))
    asked = cut(base.where("asks").groupBy("vec_id", "embedding").agg(F.min("row").alias("qid")))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest, n = base.agg(F.sqrt(F.max(square)), F.count("*")).first()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-asked.count() // BLOCK))
    number = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    data = base.select(F.lit(-1).cast("long").alias("qid"), "vec_id", "embedding", number("row", blocks).alias("block"), every(parts).alias("part"))
    asks = asked.select("qid", "vec_id", "embedding", number("qid", parts).alias("part"), every(blocks).alias("block"))
    rows = data.unionByName(asks).withColumn("cell", F.xxhash64("block", "part", F.size("embedding"))).withColumn("longest", F.lit(longest or 1.0))
    found = rows.select("cell", "qid", "vec_id", "longest", "embedding").repartition("cell").sortWithinPartitions("cell", "qid", "vec_id").mapInArrow(_search(k), "qid long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op6_collision_ann": op6_collision_ann}
ORACLES: dict[str, str] = {}
