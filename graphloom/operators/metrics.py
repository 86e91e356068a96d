"""Operational metrics over operations(ts, op, duration_us, is_error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.exprs import components_hash

#: Upper bounds of the latency buckets in microseconds; the last bucket takes all.
BUCKETS = (100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 1000000, 10000000)


def histogram(ops: DataFrame, value: str = "duration_us", bounds=BUCKETS) -> DataFrame:
    """(op, bound, cumulative, total, sum, mean): one aggregation with a column per bucket, then unpivoted."""
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(str(b)) for b in bounds]
    wide = ops.groupBy("op").agg(F.count(value).alias("total"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), *sums).withColumn("Infinity", F.col("total"))
    return wide.unpivot(["op", "total", "sum", "mean"], [*map(str, bounds), "Infinity"], "bound", "cumulative").select("op", F.col("bound").cast("double").alias("bound"), "cumulative", "total", "sum", "mean")


def percentile(ops: DataFrame, share: float, value: str = "duration_us", bounds=BUCKETS) -> DataFrame:
    """(op, bound): the first bucket that reaches this share of an operation's samples."""
    h = histogram(ops, value, bounds).where((F.col("total") > 0) & (F.col("cumulative") >= F.col("total") * share))
    return h.groupBy("op").agg(F.min("bound").alias("bound"))


def rate(ops: DataFrame, window_rows: int = 60, value: str | None = None) -> DataFrame:
    """Each sample with the sum of its operation's last samples by the seconds they span; 0 for fewer than two, or no time."""
    w = Window.partitionBy("op").orderBy("ts", "seq").rowsBetween(-(window_rows - 1), 0)
    amount = F.col(value) if value else F.lit(1)
    seconds = (F.unix_micros(F.max("ts").over(w).cast("timestamp")) - F.unix_micros(F.min("ts").over(w).cast("timestamp"))) / 1e6
    total = F.sum(amount).over(w)
    return ops.withColumn("rate", F.when((F.count("*").over(w) < 2) | (seconds <= 0), 0.0).otherwise(total / F.nullif(seconds, F.lit(0.0))))


def error_rate(ops: DataFrame) -> DataFrame:
    """(op, total, errors, error_percent)."""
    errors = F.sum(F.col("is_error").cast("long"))
    return ops.groupBy("op").agg(F.count("*").alias("total"), errors.alias("errors"), (F.lit(100.0) * errors / F.count("*")).alias("error_percent"))


def health(checks: DataFrame, warning: float = 1.0, critical: float = 5.0) -> DataFrame:
    """The worst of checks(name, value): healthy, degraded from ``warning`` on, unhealthy from ``critical`` on."""
    severity = F.when(F.col("value") >= critical, 2).when(F.col("value") >= warning, 1).otherwise(0)
    worst = checks.agg(F.coalesce(F.max(severity), F.lit(0)).alias("severity"), F.count("*").alias("checks"))
    return worst.select("checks", F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("severity") + 1).alias("status"))


def ema(ops: DataFrame, value: str = "duration_us", alpha: float = 0.1) -> DataFrame:
    """(op, ema): the first sample, then alpha of each later one, in the order of (ts, seq).

    Written as a sum of weighted samples, weights alpha (1 - alpha)^k by age k, so that it aggregates in parts; the ages come from
    a window by operation.
    """
    w = Window.partitionBy("op").orderBy(F.desc("ts"), F.desc("seq"))
    aged = ops.select("op", value, (F.row_number().over(w) - 1).alias("age"), F.count("*").over(Window.partitionBy("op")).alias("n"))
    weight = F.pow(F.lit(1 - alpha), F.col("age")) * F.when(F.col("age") == F.col("n") - 1, 1.0).otherwise(alpha)
    return aged.groupBy("op").agg(F.sum(F.col(value) * weight).alias("ema"))


def counters(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count("*").alias("count"))


def prometheus(counts: DataFrame, name: str = "operations_total") -> DataFrame:
    """Exposition lines."""
    return counts.select(F.format_string(f'{name}{{op="%s"}} %d', "op", "count").alias("line"))


def hit_ratio(accesses: DataFrame) -> DataFrame:
    """(hits, misses, hit_ratio) of accesses(is_hit)."""
    hits = F.coalesce(F.sum(F.col("is_hit").cast("long")), F.lit(0))
    return accesses.agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.when(F.count("*") == 0, 0.0).otherwise(hits / F.nullif(F.count("*"), F.lit(0))).alias("hit_ratio"))


def unexpired(accesses: DataFrame, key: str, as_of, ttl_seconds: int) -> DataFrame:
    """Keys whose last access is at most the TTL before ``as_of``."""
    last = accesses.groupBy(key).agg(F.max("ts").alias("last_access"))
    return last.where(F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_access").cast("timestamp")) <= ttl_seconds * 1_000_000)


def gauges(samples: DataFrame) -> DataFrame:
    """(name, value) as last set, of samples(name, ts, value)."""
    return samples.groupBy("name").agg(F.max_by("value", "ts").alias("value"))


def json_export(values: DataFrame) -> DataFrame:
    """A JSON line for each row."""
    return values.select(F.to_json(F.struct(*values.columns)).alias("line"))


def cache_key(*components) -> Column:
    """The key of a cached result by what was asked: (vector, k), (node, depth), (node), (src, dst) or (query, parameters)."""
    return components_hash(*components)
