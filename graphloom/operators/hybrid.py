"""The hybrid query: graph neighbourhood first, then the vectors most similar to any of it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.lineage import cut

from . import graph, vectors


class HybridResult(NamedTuple):
    related_nodes: DataFrame
    similar_vectors: DataFrame
    node_vector_map: DataFrame


def hybrid(nodes: DataFrame, edges: DataFrame, vecs: DataFrame, start: int, depth: int = 2, k: int = 10, dedup: bool = False) -> HybridResult:
    """Nodes within ``depth`` hops; the k best pairs of one of their vectors and another vector; the nodes that have a vector.

    The k best of all related nodes' k best are the k best of all pairs, and each query's k best hold them, so a blocked search
    per related vector is cut once. dedup keeps each vector once, with its best similarity.
    """
    related = cut(graph.k_hop(nodes, edges, start, depth).select("id", "depth"))  # the search counts and reads its queries
    sources = vecs.join(related, "id", "left_semi")
    found = vectors.search(vecs, sources, k=k).select("query_id", "id", "similarity")
    if dedup:
        found = found.groupBy("id").agg(F.max("similarity").alias("similarity"), F.min("query_id").alias("query_id")).select("query_id", "id", "similarity")
    best = found.orderBy(F.desc(F.round("similarity", 12)), "query_id", "id").limit(k)
    return HybridResult(related, best, sources.select(F.col("id").alias("node_id"), F.col("id").alias("vector_id")))
