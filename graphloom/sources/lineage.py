"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only in a local session that has none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='graphloom-')}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, first: int = 0) -> DataFrame:
    """df, read from a checkpoint, with a column of dense numbers from ``first`` in the order of its rows.

    Each partition's rows are counted; only one number for each partition comes to the driver, so no task numbers all rows.
    """
    rows = cut(df.withColumn(name, F.monotonically_increasing_id()))
    part, place = F.shiftright(F.col(name), 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = first, []
    for r in sorted(rows.groupBy(part.alias("p")).count().collect()):
        starts.append((r.p, before))
        before += r["count"]
    at = f"{name}_of_partition"
    known = F.broadcast(df.sparkSession.createDataFrame(starts, f"`{at}` long, `{at}_start` long"))  # a row for each partition
    return rows.join(known, part == F.col(at)).withColumn(name, F.col(f"{at}_start") + place).drop(at, f"{at}_start")
