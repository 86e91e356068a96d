"""What the training-data operators share: the shared folder, lineage cuts, Arrow runs, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.lineage import cut, shared_dir

#: Words as the contracts define them: maximal runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hot join keys are dealt to this many salted parts.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, in this application's part of it."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> bool:
    """Deletes all that this application has below ``scratch``: once results are written, or before it ends. Results not yet written need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, where columns can be pruned on each later read."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (but the last) that never cut a run of equal keys; the input is sorted by key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t.column(key).to_numpy()
        end = int(np.searchsorted(keys, keys[-1], "left"))
        if end:
            yield t.slice(0, end)
            rest = t.slice(end)
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def steps(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes in column ``at``, a row at least."""
    column = batch.column(at)
    sizes = np.diff(np.frombuffer(column.buffers()[1], "i4" if column.type in (pa.string(), pa.binary()) else "i8")[column.offset : column.offset + len(column) + 1]) if len(column) else np.empty(0, "i8")
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype="i8") // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For vertices 0..n-1 joined by edges (a, b): the smallest vertex of each one's component."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        a, b = a[label[a] != label[b]], b[label[a] != label[b]]
    return label


class Stars:
    """Joins edges within one task and keeps a spanning star for each component, never the pairs themselves."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.rows, self.held = most, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.rows += len(a)
            if self.rows > self.most:
                a, b = self.edges()
                self.held, self.rows = [(a, b)], len(a)
                self.most = max(self.most, 2 * self.rows)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, "i8"), np.empty(0, "i8")
        a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
        ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = local_labels(len(ids), code[: len(a)], code[len(a) :])
        own = label != np.arange(len(ids))
        return ids[own], ids[label[own]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stars = Stars()
    for batch in batches:
        stars.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
    a, b = stars.edges()
    for at in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id with an edge in edges(a long, b long): component is the smallest id that is reachable.

    Alternating large-star and small-star steps over distributed edges, O(log^2) rounds; each round is cut by a checkpoint.
    Every task first replaces its edges by spanning stars. Joins on a vertex are salted, since a component's
    smallest vertex can touch a third of all edges. Edges are never brought to the driver, only their count and checksum.
    """

    def salted(left: DataFrame, on: str, other: str, least: DataFrame) -> DataFrame:
        left = left.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
        least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
        return left.join(least.withColumnRenamed("id", on), [on, "salt"], "left")

    def mins(e: DataFrame) -> DataFrame:
        return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(ordered(ordered(edges.select("a", "b")).mapInArrow(_forest, "a long, b long")))
    before = state(e)
    for _ in range(rounds):
        # large star: each edge (a > b) moves from b to the smallest neighbour of b
        e = ordered(salted(e, "b", "a", mins(e)).select("a", F.coalesce("least", "b").alias("b")))
        # small star: a and all its smaller neighbours move to the smallest one
        j = salted(e, "a", "b", mins(e))
        e = cut(ordered(j.select(F.explode(F.array(F.struct(F.col("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.a", "e.b")))
        now = state(e)
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
