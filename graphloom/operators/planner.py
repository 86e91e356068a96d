"""The cost model and strategy rules as expressions, and statistics and advice over recorded queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.exprs import components_hash

SCAN, EDGE, VECTOR, LOOKUP, HIT, MISS, SELECTIVITY = 100.0, 150.0, 500.0, 50.0, 10.0, 1000.0, 0.1  # nanoseconds; a share


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x)


def linear_cost(n, selectivity=SELECTIVITY, scan=SCAN) -> Column:
    return _c(n) * _c(scan) * _c(selectivity)


def index_cost(n, selectivity=SELECTIVITY, scan=SCAN) -> Column:
    return F.log(_c(n).cast("double")) * LOOKUP + _c(n) * _c(selectivity) * _c(scan) * 0.1


def vector_cost(n, dims) -> Column:
    return _c(n) * VECTOR * _c(dims) / 128.0


def graph_cost(degree, depth) -> Column:
    return F.pow(_c(degree).cast("double"), _c(depth)) * EDGE


def should_use_index(n, selectivity) -> Column:
    return index_cost(n, selectivity) < linear_cost(n, selectivity)


def strategy(pattern: str = "pattern", n: str = "n", selectivity: str = "selectivity", cached: str = "cached") -> Column:
    """The access path by query pattern, size and selectivity."""
    p, size, s = F.col(pattern), F.col(n), F.col(selectivity)
    return (
        F.when(F.col(cached), "cache").when(p == "point", "index").when((p == "range") & (s < 0.1), "index").when(p == "range", "scan")
        .when(p == "similarity", F.when(size > 1000, "vector_index").otherwise("scan")).when(p == "traversal", "graph")
        .when((p == "complex") & (s < 0.01), "index").when((p == "complex") & (size > 5000), "hybrid").when(p == "complex", "scan").otherwise("scan")
    )


def priority(cost, selectivity) -> Column:
    return 1.0 / (_c(cost) * _c(selectivity) + 0.001)


def plan_cost(kind: str = "strategy", base: str = "cost") -> Column:
    return F.col(base) * F.when(F.col(kind) == "hybrid", 1.2).when(F.col(kind) == "custom", 0.8).otherwise(1.0)


def recorded(queries: DataFrame) -> DataFrame:
    """(query_hash, runs, mean_us, slowest_us) of queries(query_hash, duration_us)."""
    return queries.groupBy("query_hash").agg(F.count("*").alias("runs"), F.avg("duration_us").alias("mean_us"), F.max("duration_us").alias("slowest_us"))


def recommendations(queries: DataFrame, slow_us: float = 1000.0, miss_ratio: float = 0.3, many: int = 1000) -> DataFrame:
    """(query_hash, slow, uncached, parallel) of queries(query_hash, duration_us, is_hit)."""
    g = queries.groupBy("query_hash").agg(F.count("*").alias("runs"), F.avg("duration_us").alias("mean_us"), F.avg((~F.col("is_hit")).cast("double")).alias("misses"))
    return g.select("query_hash", (F.col("mean_us") > slow_us).alias("slow"), (F.col("misses") > miss_ratio).alias("uncached"), (F.col("runs") > many).alias("parallel"))


def statistics(queries: DataFrame) -> DataFrame:
    """(queries, patterns, hit_ratio, mean_us) of queries(query_hash, duration_us, is_hit)."""
    return queries.agg(F.count("*").alias("queries"), F.countDistinct("query_hash").alias("patterns"), F.coalesce(F.avg(F.col("is_hit").cast("double")), F.lit(0.0)).alias("hit_ratio"), F.avg("duration_us").alias("mean_us"))


def adapted(queries: DataFrame, initial: float, alpha: float = 0.1) -> DataFrame:
    """(kind, cost): each kind's cost after its queries(kind, seq, duration_us), in order, moved it by ``alpha`` towards themselves.

    The ordered fold is a weighted sum: a query with n later ones weighs alpha (1 - alpha)^n, the initial cost what is left.
    """
    later = F.count("*").over(Window.partitionBy("kind").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    weighed = queries.select("kind", "duration_us", F.pow(F.lit(1 - alpha), later).alias("w"))
    return weighed.groupBy("kind").agg((F.sum(F.col("duration_us") * F.col("w")) * alpha + F.lit(initial) * F.pow(F.lit(1 - alpha), F.count("*"))).alias("cost"))


def query_hash(pattern, selectivity, n) -> Column:
    """A query's fingerprint: its pattern's code, its selectivity in thousandths and its size in one hash."""
    return components_hash(_c(pattern), F.floor(_c(selectivity) * 1000), _c(n))
