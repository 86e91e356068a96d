"""The append log, state as its fold, snapshots with retention and recovery, and readers of the JSON and blob snapshot files."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGES, ENTRY_TYPES, LOG


class State(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    memory_contents: DataFrame


def append(entries: DataFrame, path: str) -> None:
    """One append of a whole batch, in LOG's columns."""
    entries.select(*LOG.names).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def entry(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") == seq)


def fold(log: DataFrame) -> State:
    """State at the log's end: the last entry of each node, vector and content wins, tombstones drop it; edges are a multiset, of
    which a tombstone drops all that came before it with its ends and kind. Node id 0 is no node."""

    def last(kind: str, field: str, key: str) -> DataFrame:
        own = log.where(F.col("entry_type") == ENTRY_TYPES[kind]).select("seq", "deleted", F.col(field).alias("v"))
        kept = own.groupBy(F.col(f"v.{key}").alias(key)).agg(F.max_by(F.struct("v", "deleted"), "seq").alias("x")).where("NOT coalesce(x.deleted, false)")
        # the key is the grouping's, so that a filter on it reaches the scan of the log
        return kept.select(*(F.col(key) if f.name == key else F.col(f"x.v.{f.name}").alias(f.name) for f in log.schema[field].dataType))

    edges = log.where(F.col("entry_type") == ENTRY_TYPES["edge"]).select("seq", F.coalesce("deleted", F.lit(False)).alias("deleted"), "edge.*")
    gone = edges.where("deleted").groupBy("src", "dst", "kind").agg(F.max("seq").alias("gone"))
    kept = edges.where("NOT deleted").join(gone, ["src", "dst", "kind"], "left").where("gone IS NULL OR seq > gone").select("src", "dst", "kind")
    return State(last("node", "node", "id").where("id <> 0"), kept, last("vector", "vector", "id"), last("memory_content", "memory", "memory_id"))


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")


def compact(log: DataFrame, keep_recent: int = 100_000, order: str = "seq") -> DataFrame:
    """The ``keep_recent`` entries of the largest sequence numbers, which need not be dense; entries of the last number all stay."""
    least = log.select(order).orderBy(F.desc(order)).limit(keep_recent).agg(F.min(order).alias("least"))
    return log.join(F.broadcast(least)).where(F.col(order) >= F.col("least")).drop("least")  # one row


def truncate(spark: SparkSession, path: str, covered: int, keep_recent: int = 0) -> int:
    """Rewrites the log without the entries up to sequence number ``covered``, but for the ``keep_recent`` last of these; returns the number of entries that are left.

    The new log is complete before the old one goes; ``mend`` ends what was broken off in between.
    """
    log = read_log(spark, path)
    old = compact(log.where(F.col("seq") <= covered), keep_recent) if keep_recent else log.limit(0)
    old.select(*LOG.names).unionByName(log.where(F.col("seq") > covered).select(*LOG.names)).write.mode("overwrite").parquet(f"{path}-next")
    fs, at = _fs(spark, path)
    fs.delete(at, True)
    mend(spark, path)
    return read_log(spark, path).count()


def mend(spark: SparkSession, path: str) -> None:
    """Puts the finished new log of a truncation in the place of the old one, if that is gone."""
    fs, at = _fs(spark, path)
    _, done = _fs(spark, f"{path}-next/_SUCCESS")
    if not fs.exists(at) and fs.exists(done):
        fs.rename(done.getParent(), at)


def first_contents(log: DataFrame) -> DataFrame:
    """(memory_id, content) as first logged; ``fold`` has the latest."""
    own = log.where(F.col("entry_type") == ENTRY_TYPES["memory_content"]).where("NOT coalesce(deleted, false)")
    return own.groupBy(F.col("memory.memory_id").alias("memory_id")).agg(F.min_by(F.col("memory.content"), "seq").alias("content"))


def reload(sources: list[DataFrame], key: str) -> DataFrame:
    """The rows of several sources in the order of their priority: a key comes from the first source that has it, the others' rows stay out."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more.select(*out.columns).join(out.select(key).distinct(), key, "left_anti").select(*out.columns))
    return out


def snapshot(state: State, base: str, snapshot_id: int, max_seq: int, timestamp: str) -> dict:
    """Writes the state's tables and then the manifest, whose presence makes the snapshot count. Returns the manifest."""
    spark = state.nodes.sparkSession
    counts = {}
    for name, df in state._asdict().items():
        path = f"{base}/snapshot={snapshot_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        counts[name] = spark.read.schema(df.schema).parquet(path).count()
    manifest = {"snapshot_id": snapshot_id, "timestamp": timestamp, "max_seq": max_seq, "counts": counts}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/manifests/{snapshot_id:06d}")
    return manifest


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifests(spark: SparkSession, base: str) -> list[dict]:
    """All snapshots' manifests by id."""
    fs, path = _fs(spark, f"{base}/manifests")
    if not fs.exists(path):
        return []
    return sorted((json.loads(r.value) for r in spark.read.text(f"{base}/manifests/*").collect()), key=lambda m: m["snapshot_id"])


def load_snapshot(spark: SparkSession, base: str, snapshot_id: int | None = None) -> tuple[State, dict] | None:
    """The latest snapshot, or one by id; None if there is none."""
    found = [m for m in manifests(spark, base) if snapshot_id in (None, m["snapshot_id"])]
    if not found:
        return None
    m = found[-1]
    return State(*(spark.read.parquet(f"{base}/snapshot={m['snapshot_id']}/{name}") for name in State._fields)), m


def recover(spark: SparkSession, base: str, log: DataFrame) -> State:
    """The latest snapshot with the log's entries after it."""
    loaded = load_snapshot(spark, base)
    if loaded is None:
        return fold(log)
    state, m = loaded
    entries = as_entries(state, m["max_seq"])
    return fold(entries.unionByName(log.where(F.col("seq") > m["max_seq"]).select(*LOG.names)))


def as_entries(state: State, seq: int) -> DataFrame:
    """A state as log entries of one sequence number."""
    out = None
    for kind, field, df in (("node", "node", state.nodes), ("edge", "edge", state.edges), ("vector", "vector", state.vectors), ("memory_content", "memory", state.memory_contents)):
        rows = df.select(F.struct(*df.columns).alias(field))
        cols = {"seq": F.lit(seq).cast("long"), "ts": F.lit(None), "entry_type": F.lit(ENTRY_TYPES[kind]), field: F.col(field), "deleted": F.lit(False)}
        rows = rows.select(*(cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG.fields))
        out = rows if out is None else out.unionByName(rows)
    return out


def retained(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` of snapshots(snapshot_id)."""
    return snapshots.orderBy(F.desc("snapshot_id")).limit(keep)


def retain(spark: SparkSession, base: str, keep: int = 10) -> list[int]:
    """Deletes all but the newest ``keep`` snapshots, the manifest of each first; returns the deleted ids."""
    old = [m["snapshot_id"] for m in manifests(spark, base)[: -keep or None]]
    for i in old:
        for path in (f"{base}/manifests/{i:06d}", f"{base}/snapshot={i}"):
            fs, p = _fs(spark, path)
            fs.delete(p, True)
    return old


def read_nodes_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, label string").option("multiLine", True).json(path)


def read_edges_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("`from` long, `to` long, kind short").option("multiLine", True).json(path).select(F.col("from").alias("src"), F.col("to").alias("dst"), "kind")


def read_contents_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("memory_id long, content string").option("multiLine", True).json(path)


def read_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    files = ", ".join(f"{n}_files array<string>" for n in ("vector", "node", "edge", "memory_content"))
    return spark.read.schema(f"snapshot_id long, timestamp string, {files}").option("multiLine", True).json(path)


def read_vector_blob(spark: SparkSession, path: str, width: int = 128) -> DataFrame:
    """Records of a little-endian 64-bit id and ``width`` 32-bit floats."""
    import numpy as np
    import pandas as pd

    kind = np.dtype([("id", "<i8"), ("dims", "<f4", (width,))])

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = np.frombuffer(content[: len(content) // kind.itemsize * kind.itemsize], kind)
                yield pd.DataFrame({"id": rows["id"], "dims": list(rows["dims"])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, dims array<float>")


def write_edges_sorted(edges: DataFrame, path: str, partitions: int | None = None) -> None:
    """The edge set, dealt and sorted by source and by kind, so that lookups by either skip files and row groups."""
    own = edges.distinct()
    own = own.repartitionByRange(partitions, "src") if partitions else own.repartitionByRange("src")
    own.sortWithinPartitions("src", "dst").write.mode("overwrite").partitionBy("kind").parquet(path)


def lookup_edges(spark: SparkSession, path: str, src: int, kind: int | None = None) -> DataFrame:
    """A source's edges from the files of ``write_edges_sorted``: folders are pruned by kind, files and row groups by the range of src."""
    found = spark.read.schema(EDGES).parquet(path).where(F.col("src") == src).select(*EDGES.names)
    return found if kind is None else found.where(F.col("kind") == kind)


def range_join(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges of all sources in ids(id)."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(*edges.columns)


def write_vectors_sorted(vectors: DataFrame, path: str, partitions: int | None = None) -> None:
    """Vectors by id, so that a lookup reads one row group."""
    own = vectors.repartitionByRange(partitions, "id") if partitions else vectors.repartitionByRange("id")
    own.sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def lookup_vector(spark: SparkSession, path: str, vector_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("id") == vector_id)
