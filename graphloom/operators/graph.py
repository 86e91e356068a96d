"""Graph operators over nodes(id, label) and edges(src, dst, kind). Traversal ignores direction; edges may dangle and repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.lineage import cut

MAX_DEPTH = 10


def get_node(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def exists(nodes: DataFrame, node_id: int) -> bool:
    return not get_node(nodes, node_id).isEmpty()


def outgoing(edges: DataFrame, node_id: int) -> DataFrame:
    return edges.where(F.col("src") == node_id)


def incoming(edges: DataFrame, node_id: int) -> DataFrame:
    return edges.where(F.col("dst") == node_id)


def by_kind(edges: DataFrame, kind: int) -> DataFrame:
    return edges.where(F.col("kind") == kind)


def both_ways(edges: DataFrame, neighbor_cap: int | None = None) -> DataFrame:
    """Each edge from either end: (id, other). A cap keeps the smallest neighbours of each node."""
    adjacent = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    if neighbor_cap is None:
        return adjacent
    rank = F.row_number().over(Window.partitionBy("id").orderBy("other"))
    return adjacent.distinct().withColumn("rank", rank).where(F.col("rank") <= neighbor_cap).drop("rank")


def neighbors(edges: DataFrame, node_id: int) -> DataFrame:
    """Distinct neighbours in either direction."""
    out = outgoing(edges, node_id).select(F.col("dst").alias("id"))
    return out.union(incoming(edges, node_id).select(F.col("src").alias("id"))).distinct()


def k_hop(nodes: DataFrame, edges: DataFrame, start, depth: int | None = None, neighbor_cap: int | None = None) -> DataFrame:
    """(source, id, depth): nodes within ``depth`` hops (None: MAX_DEPTH), each at its least depth, the start at 0; ids without a node are passed through but not returned.

    ``start`` is an id, or a DataFrame (source) of ids, which are all followed at once: a semi-naive loop joins the last level
    with the edges, so its work follows the levels' size, and each level is cut by a checkpoint.
    """
    depth = MAX_DEPTH if depth is None else depth
    spark = edges.sparkSession
    first = spark.createDataFrame([(start,)], "source long") if isinstance(start, int) else start.select(F.col("source").cast("long").alias("source")).distinct()
    seen = first.select("source", F.col("source").alias("id"), F.lit(0).alias("depth"))
    frontier, adjacent = seen, both_ways(edges, neighbor_cap)
    for level in range(1, depth + 1):
        found = frontier.join(adjacent, "id").select("source", F.col("other").alias("id")).distinct()
        frontier = found.join(seen, ["source", "id"], "left_anti").withColumn("depth", F.lit(level))
        if level < depth:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen.join(nodes.select("id").distinct(), "id", "left_semi").select("source", "id", "depth")


def shortest_path(edges: DataFrame, start: int, end: int, max_depth: int | None = None) -> DataFrame:
    """(position, id) of a shortest undirected path, by the smallest parents; empty if there is none, or none within max_depth."""
    spark = edges.sparkSession
    out = "position int, id long"
    if start == end:
        return spark.createDataFrame([(0, start)], out)
    adjacent = both_ways(edges)
    levels = [spark.createDataFrame([(start, None)], "id long, parent long")]
    seen, reached = levels[0].select("id"), False
    while max_depth is None or len(levels) <= max_depth:
        found = levels[-1].join(adjacent, "id").groupBy(F.col("other").alias("id")).agg(F.min("id").alias("parent"))
        level = cut(found.join(seen, "id", "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level.select("id"))
        if not level.where(F.col("id") == end).isEmpty():
            reached = True
            break
    if not reached:
        return spark.createDataFrame([], out)
    path = [end]
    for level in reversed(levels[1:]):  # one row of each level
        path.append(level.where(F.col("id") == path[-1]).first().parent)
    return spark.createDataFrame([(k, x) for k, x in enumerate(reversed(path))], out)


def by_edge_kind(nodes: DataFrame, edges: DataFrame, node_id: int, kind: int, direction: str = "outgoing") -> DataFrame:
    """Existing nodes at the other end of a node's edges of one kind; repeated edges repeat them."""
    out = edges.where((F.col("src") == node_id) & (F.col("kind") == kind)).select(F.col("dst").alias("id"))
    into = edges.where((F.col("dst") == node_id) & (F.col("kind") == kind)).select(F.col("src").alias("id"))
    found = {"outgoing": out, "incoming": into, "both": out.unionAll(into)}[direction]
    return found.join(nodes, "id")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edge ends at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def explore(nodes: DataFrame, edges: DataFrame, start: int, depth: int = 2) -> DataFrame:
    """k-hop nodes with label, their sorted outgoing and incoming ends; raises if the start is no node."""
    if not exists(nodes, start):
        raise KeyError(f"no node {start}")
    near = k_hop(nodes, edges, start, depth).select("id", "depth")
    # the lists are of edges that touch the found nodes only
    out = edges.join(near, F.col("src") == F.col("id"), "left_semi").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("outgoing"))
    into = edges.join(near, F.col("dst") == F.col("id"), "left_semi").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("incoming"))
    none = F.expr("cast(array() as array<bigint>)")
    return near.join(nodes, "id").join(out, "id", "left").join(into, "id", "left").select("id", "label", "depth", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"))


def remove_node(nodes: DataFrame, edges: DataFrame, node_id: int) -> tuple[DataFrame, DataFrame]:
    """Without the node and all edges that touch it."""
    return nodes.where(F.col("id") != node_id), edges.where((F.col("src") != node_id) & (F.col("dst") != node_id))


def remove_edge(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """Without one edge between the two, of the smallest kind."""
    one = (F.col("src") == src) & (F.col("dst") == dst)
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy("kind"))
    return edges.where(~one).unionByName(edges.where(one).withColumn("rank", rank).where("rank > 1").drop("rank"))


def touching(edges: DataFrame, node_id: int) -> DataFrame:
    return edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))


def orphans(nodes: DataFrame, edges: DataFrame, kind: int | None = None) -> DataFrame:
    """Nodes without any edge (of a kind) at either end."""
    own = edges if kind is None else by_kind(edges, kind)
    ends = own.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def orphaned_concepts(nodes: DataFrame, edges: DataFrame, kind: int = 2) -> DataFrame:
    """Concepts (negative ids) that no memory (id from 0) is joined to by an edge of this kind."""
    own = by_kind(edges, kind)
    held = own.where("src >= 0").select(F.col("dst").alias("id")).union(own.where("dst >= 0").select(F.col("src").alias("id")))
    return nodes.where("id < 0").join(held, "id", "left_anti")


def kind_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("edges"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("node_count"))
    e = edges.agg(F.count("*").alias("edge_count"), F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("long")), F.lit(0)).alias("loops"))
    return n.join(e)  # one row each


def concept_network(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of memory and concept nodes and the mean out-degree of memories."""
    n = nodes.agg(F.sum((F.col("id") >= 0).cast("long")).alias("memories"), F.sum((F.col("id") < 0).cast("long")).alias("concepts"))
    e = edges.where("src >= 0").agg(F.count("*").alias("out_edges"))
    return n.join(e).select("memories", "concepts", (F.col("out_edges") / F.nullif("memories", F.lit(0))).alias("mean_out_edges"))
