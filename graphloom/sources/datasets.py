"""The driver's tables as the engine's tables. Ids of the star schema's tables are kept apart by namespaces of 10^12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGE_KINDS

NAMESPACES = {"region": 1, "nation": 2, "supplier": 3, "customer": 4, "part": 5, "orders": 6}
SPACE = 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(name: str, key) -> Column:
    return (F.col(key) if isinstance(key, str) else F.lit(key)).cast("long") + F.lit(NAMESPACES[name] * SPACE)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, label in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", None)):
        t = table(spark, sf_dir, name)
        rows = t.select(node_id(name, key).alias("id"), (F.col(label) if label else F.lit(name)).alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer owns orders; orders link parts; customers and suppliers are related to nations; nations are children of regions."""
    kind = lambda k: F.lit(EDGE_KINDS[k]).cast("short").alias("kind")
    t = lambda name: table(spark, sf_dir, name)
    owns = t("orders").select(node_id("customer", "o_custkey").alias("src"), node_id("orders", "o_orderkey").alias("dst"), kind("owns"))
    links = t("lineitem").select(node_id("orders", "l_orderkey").alias("src"), node_id("part", "l_partkey").alias("dst"), kind("links"))
    customers = t("customer").select(node_id("customer", "c_custkey").alias("src"), node_id("nation", "c_nationkey").alias("dst"), kind("related"))
    suppliers = t("supplier").select(node_id("supplier", "s_suppkey").alias("src"), node_id("nation", "s_nationkey").alias("dst"), kind("related"))
    children = t("nation").select(node_id("nation", "n_nationkey").alias("src"), node_id("region", "n_regionkey").alias("dst"), kind("child_of"))
    return owns.unionByName(links).unionByName(customers).unionByName(suppliers).unionByName(children)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dims"), "label")


def part_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors under the ids of the part nodes of the same key."""
    return vectors(spark, sf_dir).select(node_id("part", "id").alias("id"), "dims")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories: codes and times by whole-number rules of doc_id, confidence by the quality label."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    confidence = F.when(F.col("quality") == 1, 3).when(F.col("quality") == 0, 1).otherwise(2)
    return d.join(labels, "doc_id", "left").select(
        i.alias("id"), F.pmod(i, F.lit(10)).cast("short").alias("memory_type"), F.col("text").alias("content"), confidence.cast("short").alias("confidence"),
        F.pmod(F.floor(i / 10), F.lit(5)).cast("short").alias("importance"), F.pmod(i, F.lit(6)).cast("short").alias("source"),
        F.timestamp_seconds(F.lit(1_700_000_000) + i * 60).alias("created_at"), F.timestamp_seconds(F.lit(1_700_000_000) + i * 61).alias("last_accessed"),
        F.lit(0).cast("long").alias("access_count"), F.floor(i / 10).cast("long").alias("session_id"), F.pmod(i, F.lit(7)).cast("long").alias("user_id"), F.lit(1).alias("version"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents precede the next of their session; every seventh references the document of half its id."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    kinds = F.array(
        F.when(F.pmod("id", F.lit(10)) < 9, F.struct((F.col("id") + 1).alias("dst"), F.lit(7).cast("short").alias("relation"))),
        F.when(F.pmod("id", F.lit(7)) == 0, F.struct(F.floor(F.col("id") / 2).cast("long").alias("dst"), F.lit(6).cast("short").alias("relation"))),
    )
    rows = ids.select(F.col("id").alias("src"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("r"))
    return rows.select("src", "r.dst", "r.relation", (F.pmod("src", F.lit(10)) / 10).cast("float").alias("strength"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("op"), (F.col("value") * 1000).alias("duration_us"), (F.col("event_type") == "error").alias("is_error"), "user_id")
