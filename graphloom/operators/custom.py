"""Caller's functions over batches: map and reduce by key, plain batch processing, and the pool's statistics as aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_reduce(rows: DataFrame, mapper: Callable[[pd.DataFrame], pd.DataFrame], reducer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, combine: bool = False) -> DataFrame:
    """mapper gives (key, value) rows for each batch; reducer gets all rows of one key.

    combine also runs the reducer within each batch first, which is right if it may be applied in parts; a frequent key then moves one
    row per batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = mapper(batch)
            if combine and len(pairs):
                pairs = pd.concat([reducer(own) for _, own in pairs.groupby("key", sort=False)])
            yield pairs

    return rows.mapInPandas(run, schema).groupBy("key").applyInPandas(reducer, schema)


def process_batches(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return rows.mapInPandas(run, schema)


def for_each(rows: DataFrame, function: Callable) -> None:
    """Runs function over each partition's rows for its effect; a partition may be run again, so effects must bear it."""
    rows.foreachPartition(function)


def pool_statistics(tasks: DataFrame, workers: int) -> DataFrame:
    """(submitted, completed, completion_rate, mean_us, utilisation) of tasks(started_us, ended_us null if not yet)."""
    took = F.col("ended_us") - F.col("started_us")
    span = F.max("ended_us") - F.min("started_us")
    done = F.count("ended_us")
    return tasks.agg(
        F.count("*").alias("submitted"), done.alias("completed"), F.when(F.count("*") == 0, 0.0).otherwise(done / F.nullif(F.count("*"), F.lit(0))).alias("completion_rate"),
        F.avg(took).alias("mean_us"), (F.sum(took) / F.nullif(span * workers, F.lit(0))).alias("utilisation"),
    )
