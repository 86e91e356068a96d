"""One object with the engine's verbs over a base folder: inserts append to the log, reads see its fold, queries return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, hybrid, memory, metrics, vectors
from graphloom.sources import store
from graphloom.sources.config import Config
from graphloom.sources.lineage import cut, numbered
from graphloom.sources.schema import EDGE_KINDS, ENTRY_TYPES, LOG, MEMORY_RELATIONS, SESSIONS


class Engine:
    """Single-writer: batches come one after another, and each gets the next sequence numbers."""

    def __init__(self, spark: SparkSession, base: str, config: Config | None = None):
        self.spark, self.base, self.config = spark, base.rstrip("/"), config or Config()
        self.log_path, self.snapshots = f"{self.base}/log", f"{self.base}/snapshots"
        store.mend(spark, self.log_path)
        if not self._has_log():
            spark.createDataFrame([], LOG).write.mode("append").parquet(self.log_path)

    def _has_log(self) -> bool:
        fs, path = store._fs(self.spark, self.log_path)
        return fs.exists(path)

    # ---- writes ----

    def insert(self, kind: str, rows: DataFrame, deleted: bool = False) -> None:
        """A batch of nodes, edges, vectors or memory contents, in their columns; deleted writes tombstones."""
        field = "memory" if kind == "memory_content" else kind
        names = [f.name for f in LOG[field].dataType.fields]
        rows = numbered(rows.select(F.struct(*(F.col(n).cast(LOG[field].dataType[n].dataType).alias(n) for n in names)).alias(field)), "seq", self.last_seq() + 1)
        full = {"seq": F.col("seq"), "ts": F.current_timestamp(), "entry_type": F.lit(ENTRY_TYPES[kind]), field: F.col(field), "deleted": F.lit(deleted)}
        store.append(rows.select(*(full.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG.fields)), self.log_path)
        every = self.config.snapshot_auto_interval
        if every and self.last_seq() - self._covered() >= every:  # numbers are dense
            self.snapshot()

    def insert_nodes(self, rows: DataFrame) -> None:
        self.insert("node", rows)

    def insert_edges(self, rows: DataFrame) -> None:
        self.insert("edge", rows)

    def insert_vectors(self, rows: DataFrame) -> None:
        self.insert("vector", rows)

    def insert_batch(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, vecs: DataFrame | None = None) -> None:
        for kind, rows in (("node", nodes), ("edge", edges), ("vector", vecs)):
            if rows is not None:
                self.insert(kind, rows)

    def remove_node(self, node_id: int) -> None:
        """The node and every edge that touches it."""
        s = self.state()
        self.insert("edge", graph.touching(s.edges, node_id).distinct(), deleted=True)
        self.insert("node", graph.get_node(s.nodes, node_id), deleted=True)

    def remove_vector(self, vector_id: int) -> None:
        self.insert("vector", self.state().vectors.where(F.col("id") == vector_id), deleted=True)

    def remove_edge(self, src: int, dst: int) -> None:
        """One edge between the two, of the smallest kind; others of that kind between them go with it, as the log's tombstones have no count."""
        own = self.state().edges.where((F.col("src") == src) & (F.col("dst") == dst))
        self.insert("edge", own.groupBy("src", "dst").agg(F.min("kind").alias("kind")), deleted=True)

    def clear_vectors(self) -> None:
        self.insert("vector", self.state().vectors, deleted=True)

    def compact(self) -> int:
        """A snapshot, then the log without the entries that it covers, but for the configured number of last ones; the number of entries left."""
        return store.truncate(self.spark, self.log_path, self.snapshot()["max_seq"], self.config.log_compaction_keep_recent)

    # ---- relations and sessions: tables of their own beside the log ----

    def _table(self, name: str, schema) -> DataFrame:
        fs, path = store._fs(self.spark, f"{self.base}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame, schema) -> None:
        have = set(rows.columns)
        cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        rows.select(*cols).write.mode("append").parquet(f"{self.base}/{name}")

    def relate(self, rows: DataFrame) -> None:
        """rows(src, dst, relation, strength, ...): relations between memories."""
        self._append("relations", rows.withColumn("created_at", F.current_timestamp()), MEMORY_RELATIONS)

    def relations(self) -> DataFrame:
        """As last set for each pair and relation."""
        rest = [c for c in MEMORY_RELATIONS.names if c not in ("src", "dst", "relation")]
        own = self._table("relations", MEMORY_RELATIONS).groupBy("src", "dst", "relation").agg(F.max_by(F.struct(*rest), "created_at").alias("v"))
        return own.select("src", "dst", "relation", *(F.col(f"v.{c}").alias(c) for c in rest))

    def set_session(self, rows: DataFrame) -> None:
        """rows(id, user_id, title, context, ...): creates sessions, or their next state, with one interaction more."""
        now = F.current_timestamp()
        self._append("sessions", rows.withColumns({"started_at": now, "last_active": now, "interaction_count": F.lit(1), "is_active": F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in rows.columns else F.lit(True)}), SESSIONS)

    def sessions(self) -> DataFrame:
        return memory.latest_sessions(self._table("sessions", SESSIONS))

    def session(self, session_id: int) -> DataFrame:
        return self.sessions().where(F.col("id") == session_id)

    # ---- state ----

    def log(self) -> DataFrame:
        return store.read_log(self.spark, self.log_path)

    def last_seq(self) -> int:
        """The largest sequence number; a truncated log goes on from its snapshot's."""
        return max(self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0], self._covered())

    def _covered(self) -> int:
        known = store.manifests(self.spark, self.snapshots)
        return known[-1]["max_seq"] if known else 0

    def state(self) -> store.State:
        return store.recover(self.spark, self.snapshots, self.log())

    def snapshot(self, timestamp: str = "") -> dict:
        known = store.manifests(self.spark, self.snapshots)
        m = store.snapshot(self.state(), self.snapshots, known[-1]["snapshot_id"] + 1 if known else 1, self.last_seq(), timestamp)
        store.retain(self.spark, self.snapshots, self.config.snapshot_cleanup_keep_count)
        return m

    def stats(self) -> DataFrame:
        s = self.state()
        counts = {"nodes": s.nodes, "edges": s.edges, "vectors": s.vectors, "memory_contents": s.memory_contents, "log_entries": self.log()}
        out = None
        for name, df in counts.items():
            row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
            out = row if out is None else out.unionByName(row)
        return out.unionByName(self.spark.createDataFrame([("snapshots", len(store.manifests(self.spark, self.snapshots)))], "measure string, value long"))

    def resource(self, name: str) -> DataFrame:
        """stats, nodes, edges or vectors as JSON lines."""
        df = self.stats() if name == "stats" else getattr(self.state(), name)
        return df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    # ---- queries ----

    def node(self, node_id: int) -> DataFrame:
        return graph.get_node(self.state().nodes, node_id)

    def related(self, start: int, depth: int | None = 2) -> DataFrame:
        """Nodes within ``depth`` hops; None: as many as the configuration says."""
        s = self.state()
        return graph.k_hop(s.nodes, s.edges, start, self.config.graph_max_traversal_depth if depth is None else depth, self.config.graph_max_neighbors_per_node or None).select("id", "depth")

    def by_kind(self, node_id: int, kind: str, direction: str = "outgoing") -> DataFrame:
        s = self.state()
        return graph.by_edge_kind(s.nodes, s.edges, node_id, edge_kind(kind), direction)

    def explore(self, start: int, depth: int = 2) -> DataFrame:
        s = self.state()
        return graph.explore(s.nodes, s.edges, start, depth)

    def shortest_path(self, a: int, b: int) -> DataFrame:
        return graph.shortest_path(self.state().edges, a, b)

    def similar(self, vector_id: int, k: int = 10) -> DataFrame:
        return vectors.top_k(self.state().vectors, vector_id, k)

    def similar_batch(self, ids: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, id, similarity): the k nearest of every vector in ids(id)."""
        own = self.state().vectors
        return vectors.search(own, own.join(ids.select("id").distinct(), "id", "left_semi"), k=k)

    def similar_threshold(self, vector_id: int, least: float | None = None) -> DataFrame:
        return vectors.threshold(self.state().vectors, vector_id, self.config.vector_similarity_threshold if least is None else least)

    def hybrid(self, start: int, depth: int = 2, k: int = 10, dedup: bool = False) -> hybrid.HybridResult:
        s = self.state()
        return hybrid.hybrid(s.nodes, s.edges, s.vectors, start, depth, k, dedup)

    # ---- the memory tools ----

    def store_memories(self, texts: DataFrame) -> None:
        """texts(id, content): contents, their embeddings, nodes of the memories and their concepts, and the edges among these."""
        from graphloom.functions.exprs import hash_embed

        own = texts.select(F.col("id").cast("long").alias("id"), "content")
        concepts, edges = memory.concept_graph(own)
        self.insert("memory_content", own.select(F.col("id").alias("memory_id"), "content"))
        self.insert("vector", own.select("id", hash_embed("content").alias("dims")))
        self.insert("node", own.select("id", F.col("content").alias("label")).unionByName(concepts))
        self.insert("edge", edges)

    def update_memory(self, memory_id: int, content: str) -> None:
        """The memory's new content, vector and label; its old concepts go as in ``forget``, its new ones come as in ``store_memories``."""
        self.forget(memory_id)
        self.store_memories(self.spark.createDataFrame([(memory_id, content)], "id long, content string"))

    def _contents(self) -> DataFrame:
        return self.state().memory_contents.select(F.col("memory_id").alias("id"), "content")

    def recall(self, text: str, limit: int = 10) -> DataFrame:
        return memory.recall_text(self._contents(), text, limit)

    def recall_similar(self, text: str, limit: int = 5) -> DataFrame:
        from graphloom.functions.exprs import hash_embed

        query = self.spark.range(1).select(hash_embed(F.lit(text)).alias("v")).first().v
        return vectors.top_k_of(self.state().vectors, list(query), limit).join(self._contents(), "id")

    def memories_of_concept(self, term: str, limit: int = 10) -> DataFrame:
        return memory.by_concept(memory.concept_rows(self._contents()), term, limit)

    def recent(self, limit: int = 5) -> DataFrame:
        return memory.recent(self._contents(), limit)

    def forget(self, memory_id: int) -> None:
        """Tombstones for the memory's edges, the concepts that only it held, its content, vector and node."""
        s = self.state()
        gone = self.spark.createDataFrame([(memory_id,)], "id long")
        _, _, nodes, edges = memory.forget(self._contents(), s.vectors, s.nodes, s.edges, gone)
        lost_edges, lost_nodes = s.edges.distinct().join(edges.distinct(), ["src", "dst", "kind"], "left_anti"), s.nodes.join(nodes, "id", "left_anti")
        content, vector = s.memory_contents.where(F.col("memory_id") == memory_id), s.vectors.where(F.col("id") == memory_id)
        for kind, rows in (("edge", lost_edges), ("memory_content", content), ("vector", vector), ("node", lost_nodes)):
            self.insert(kind, cut(rows), deleted=True)

    def health(self, checks: DataFrame) -> DataFrame:
        return metrics.health(checks, self.config.health_error_rate_warning, self.config.health_error_rate_critical)


def edge_kind(name: str) -> int:
    """The code of an edge kind's name; unknown names are ``related``."""
    return EDGE_KINDS.get(name, EDGE_KINDS["related"])
