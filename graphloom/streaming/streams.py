"""Structured Streaming forms: the log's fold kept up to date, snapshots by count, windowed metrics, idle sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import store
from graphloom.sources.schema import LOG


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of the log as they come."""
    return spark.readStream.schema(LOG).parquet(path)


def snapshot_every(log: DataFrame, log_path: str, base: str, checkpoint: str, every: int = 50_000, keep: int = 10):
    """A query that snapshots the log's state once ``every`` entries have come since the last snapshot, and keeps the newest ones.

    Entries are counted, as their numbers may have gaps. The log and the manifests alone decide, and snapshots are numbered on from the
    last one, whoever wrote it, so a batch that is run again finds its own snapshot and writes no other.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        known = store.manifests(spark, base)
        since = known[-1]["max_seq"] if known else -1
        log_ = store.read_log(spark, log_path)
        seen = log_.where(F.col("seq") > since).agg(F.count("*").alias("n"), F.max("seq").alias("top")).first()
        if seen.n >= every:
            state = store.recover(spark, base, log_.where(F.col("seq") <= seen.top))
            store.snapshot(state, base, known[-1]["snapshot_id"] + 1 if known else 1, seen.top, f"seq {seen.top}")
            store.retain(spark, base, keep)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def windowed(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by window and type; later events than the watermark are dropped when streaming."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity of each user between pauses longer than the gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")
