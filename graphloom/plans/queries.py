"""Named queries over the driver's tables, each beside its SQL. Floats are rounded here, at the edge; ties are broken by id."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import exprs
from graphloom.operators import custom, graph, hybrid, memory, metrics, placement, planner, vectors
from graphloom.sources import datasets as d
from graphloom.sources import store
from graphloom.sources.ship import ship
from graphloom.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
S = 10**12
CUSTOMER, OTHER = 4 * S + 1, 4 * S + 2
QUERIED = 50  # queries are the rows whose id is divisible by this, as one fixed set


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# ---- SQL of the tables ----

NODES = f"""nodes AS (
 SELECT CAST(r_regionkey AS BIGINT) + {1 * S} AS id, r_name AS label FROM region UNION ALL SELECT n_nationkey + {2 * S}, n_name FROM nation
 UNION ALL SELECT s_suppkey + {3 * S}, s_name FROM supplier UNION ALL SELECT c_custkey + {4 * S}, c_name FROM customer
 UNION ALL SELECT p_partkey + {5 * S}, p_name FROM part UNION ALL SELECT o_orderkey + {6 * S}, 'orders' FROM orders)"""
EDGES = f"""edges AS (
 SELECT o_custkey + {4 * S} AS src, o_orderkey + {6 * S} AS dst, 0 AS kind FROM orders UNION ALL SELECT l_orderkey + {6 * S}, l_partkey + {5 * S}, 1 FROM lineitem
 UNION ALL SELECT c_custkey + {4 * S}, c_nationkey + {2 * S}, 2 FROM customer UNION ALL SELECT s_suppkey + {3 * S}, s_nationkey + {2 * S}, 2 FROM supplier
 UNION ALL SELECT n_nationkey + {2 * S}, n_regionkey + {1 * S}, 3 FROM nation),
 adj AS (SELECT src AS id, dst AS other FROM edges UNION SELECT dst, src FROM edges)"""


def hops(start: int, depth: int) -> str:
    return f"hop AS (SELECT CAST({start} AS BIGINT) AS id, 0 AS depth UNION SELECT adj.other, hop.depth + 1 FROM hop JOIN adj USING (id) WHERE hop.depth < {depth}), khop AS (SELECT id, min(depth) AS depth FROM hop GROUP BY id)"


SIM = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
MEMORIES = """memories AS (
 SELECT documents.doc_id AS id, documents.doc_id % 10 AS memory_type, text AS content, CASE quality WHEN 1 THEN 3 WHEN 0 THEN 1 ELSE 2 END AS confidence, (documents.doc_id // 10) % 5 AS importance,
  documents.doc_id // 10 AS session_id, documents.doc_id % 7 AS user_id, 1700000000 + documents.doc_id * 60 AS created FROM documents LEFT JOIN labels USING (doc_id))"""
CONCEPTS = "list_distinct(list_filter(list_transform(string_split({t}, ' '), lambda w: lower(regexp_replace(w, '[^A-Za-z]', '', 'g'))), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'with', 'for', 'are', 'was', 'this', 'that')))"
OPS = "ops AS (SELECT event_id AS seq, ts, event_type AS op, value * 1000 AS duration_us, event_type = 'error' AS is_error, user_id FROM events)"

# ---- vectors ----


@query(f"SELECT b.vec_id AS id, round({SIM.format(a='a.embedding', b='b.embedding')}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 1 AND b.vec_id <> 1 ORDER BY similarity DESC, id LIMIT 10")
def vector_topk(spark, sf):
    return vectors.top_k(d.vectors(spark, sf), 1, 10).select("id", r6("similarity").alias("similarity"))


@query(f"SELECT b.vec_id AS id, round({SIM.format(a='a.embedding', b='b.embedding')}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 1 ORDER BY similarity DESC, id LIMIT 5")
def vector_topk_literal(spark, sf):
    v = d.vectors(spark, sf)
    return vectors.top_k_of(v, vectors.vector_of(v, 1), 5).select("id", r6("similarity").alias("similarity"))


def _queried(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % QUERIED == 0)


_BATCH = f"""SELECT a.vec_id AS query_id, b.vec_id AS id, {SIM.format(a='a.embedding', b='b.embedding')} AS similarity,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round({SIM.format(a='a.embedding', b='b.embedding')}, 12) DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERIED} = 0"""


@query(f"SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ({_BATCH}) WHERE rank <= 5")
def vector_topk_batch(spark, sf):
    v = d.vectors(spark, sf)
    return vectors.batch_top_k(v, _queried(v).select("id"), 5).select("query_id", "id", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT b.vec_id AS id, round({SIM.format(a='a.embedding', b='b.embedding')}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 1 AND b.vec_id <> 1 AND {SIM.format(a='a.embedding', b='b.embedding')} >= 0.2")
def vector_threshold(spark, sf):
    return vectors.threshold(d.vectors(spark, sf), 1, 0.2).select("id", r6("similarity").alias("similarity"))


@query(f"SELECT query_id, id, round(similarity, 6) AS similarity FROM ({_BATCH}) WHERE similarity >= 0.3")
def vector_threshold_batch(spark, sf):
    v = d.vectors(spark, sf)
    return vectors.search(v, _queried(v), least=0.3).select("query_id", "id", r6("similarity").alias("similarity"))


@query("SELECT label, p - 1 AS position, round(avg(CAST(embedding[p] AS DOUBLE)), 6) AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS p) GROUP BY label, p")
def vector_centroid_by_label(spark, sf):
    return vectors.centroid(d.vectors(spark, sf), by=["label"]).select("label", F.col("position").cast("long").alias("position"), r6("mean").alias("mean"))


@query("WITH ids AS (SELECT unnest([0, 1, 1, 2, 999999]) AS vec_id) SELECT p - 1 AS position, round(avg(CAST(embedding[p] AS DOUBLE)), 6) AS mean FROM embeddings JOIN ids USING (vec_id), (SELECT unnest(range(1, 65)) AS p) GROUP BY p")
def vector_centroid(spark, sf):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 1, 2, 999999)], "id long")
    return vectors.centroid(d.vectors(spark, sf), ids).select(F.col("position").cast("long").alias("position"), r6("mean").alias("mean"))


@query(f"WITH ids AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 999999]) AS id), v AS (SELECT id, embedding FROM ids LEFT JOIN embeddings ON vec_id = id) SELECT CAST(a.id AS BIGINT) AS a, CAST(b.id AS BIGINT) AS b, round(CASE WHEN a.id = b.id THEN 1.0 ELSE coalesce({SIM.format(a='a.embedding', b='b.embedding')}, 0) END, 6) AS similarity FROM v a, v b")
def vector_sim_matrix(spark, sf):
    return vectors.similarity_matrix(d.vectors(spark, sf), [*range(10), 999999]).select("a", "b", r6("similarity").alias("similarity"))


@query(f"SELECT query_id, count(*) AS neighbors, round(avg(similarity), 6) AS mean, round(max(similarity), 6) AS max, round(min(similarity), 6) AS min, round(stddev_pop(similarity), 6) AS std FROM ({_BATCH}) WHERE rank <= 10 GROUP BY query_id")
def vector_neighbor_stats(spark, sf):
    v = d.vectors(spark, sf)
    s = vectors.neighbor_statistics(vectors.search(v, _queried(v), k=10))
    return s.select("query_id", "neighbors", *(r6(c).alias(c) for c in ("mean", "max", "min", "std")))


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS magnitude FROM embeddings")
def vector_norms(spark, sf):
    return vectors.norms(d.vectors(spark, sf)).select("id", r6("magnitude").alias("magnitude"))


@query("SELECT vec_id AS id, len(embedding) AS width FROM embeddings WHERE vec_id = 7")
def vector_lookup(spark, sf):
    return d.vectors(spark, sf).where("id = 7").select("id", F.size("dims").cast("long").alias("width"))


@query("SELECT vec_id AS id FROM embeddings")
def vector_ids(spark, sf):
    return d.vectors(spark, sf).select("id")


@query("""WITH s AS (SELECT min(x) AS low, (max(x) - min(x)) / 255.0 AS step FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))
SELECT vec_id AS id, CAST(list_sum(list_transform(embedding, lambda x: least(255, floor((CAST(x AS DOUBLE) - low) / step)))) AS BIGINT) AS code_sum,
 list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) - (least(255, floor((CAST(x AS DOUBLE) - low) / step)) * step + low)) <= step * 1.000001)) AS within_step FROM embeddings, s""")
def vector_quantize(spark, sf):
    v = d.vectors(spark, sf).select("id", "dims")
    q = vectors.quantize(v).join(v, "id")
    error = F.zip_with("dims", "codes", lambda x, c: F.abs(x.cast("double") - (c * F.col("step") + F.col("low"))) <= F.col("step") * 1.000001)
    return q.select("id", F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: s + c).alias("code_sum"), F.forall(error, lambda e: e).alias("within_step"))


def _kmeans_sql(k: int, rounds: int) -> str:
    out = [f"v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, x AS c FROM v QUALIFY row_number() OVER (ORDER BY id) <= {k})"]
    for t in range(rounds + 1):
        out.append(f"a{t} AS (SELECT id, x, cluster FROM (SELECT v.id, v.x, c.cluster, row_number() OVER (PARTITION BY v.id ORDER BY round(list_cosine_similarity(v.x, c.c), 12) DESC, c.cluster) AS rn FROM v, c{t} c) WHERE rn = 1)")
        out.append(f"m{t} AS (SELECT cluster, p, avg(x[p]) AS m FROM a{t}, (SELECT unnest(range(1, 65)) AS p) GROUP BY cluster, p)")
        out.append(f"c{t + 1} AS (SELECT c.cluster, coalesce(n.c, c.c) AS c FROM c{t} c LEFT JOIN (SELECT cluster, list(m ORDER BY p) AS c FROM m{t} GROUP BY cluster) n USING (cluster))")
    return f"WITH {', '.join(out)} SELECT id, CAST(cluster AS BIGINT) AS cluster FROM a{rounds}"


@query(_kmeans_sql(4, 3))
def kmeans_cosine(spark, sf):
    marked, _ = vectors.k_means(d.vectors(spark, sf), 4, 3)
    return marked.select("id", F.col("cluster").cast("long").alias("cluster"))


@query()
def vector_ann(spark, sf):
    v = d.vectors(spark, sf).select("id", "dims")
    return vectors.Ivf(v).search(_queried(v), 10).select("query_id", "id", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query()
def hash_embedding(spark, sf):
    return d.table(spark, sf, "benchmark").select("item_id", exprs.hash_embed("text", 32).alias("dims"))


# ---- graph ----


@query(f"WITH {EDGES} SELECT DISTINCT other AS id FROM adj WHERE id = {CUSTOMER}")
def graph_neighbors(spark, sf):
    return graph.neighbors(d.edges(spark, sf), CUSTOMER)


@query(f"WITH {EDGES} SELECT src, dst, kind FROM edges WHERE src = {CUSTOMER}")
def graph_outgoing(spark, sf):
    return graph.outgoing(d.edges(spark, sf), CUSTOMER).select("src", "dst", F.col("kind").cast("int").alias("kind"))


@query(f"WITH {EDGES} SELECT src, dst, kind FROM edges WHERE dst = {2 * S + 3}")
def graph_incoming(spark, sf):
    return graph.incoming(d.edges(spark, sf), 2 * S + 3).select("src", "dst", F.col("kind").cast("int").alias("kind"))


@query(f"WITH {EDGES} SELECT src, dst FROM edges WHERE kind = 2")
def graph_edges_of_kind(spark, sf):
    return graph.by_kind(d.edges(spark, sf), 2).select("src", "dst")


@query(f"WITH {NODES} SELECT id, label FROM nodes WHERE id = {CUSTOMER}")
def graph_node(spark, sf):
    return graph.get_node(d.nodes(spark, sf), CUSTOMER)


for _direction, _where, _end in (("outgoing", "src", "dst"), ("incoming", "dst", "src")):

    def _by_kind(spark, sf, direction=_direction):
        return graph.by_edge_kind(d.nodes(spark, sf), d.edges(spark, sf), 2 * S + 3, 2 if direction == "incoming" else 3, direction)

    QUERIES[f"graph_by_kind_{_direction}"] = _by_kind
    ORACLES[f"graph_by_kind_{_direction}"] = f"WITH {NODES}, {EDGES} SELECT n.id, label FROM edges JOIN nodes n ON n.id = {_end} WHERE {_where} = {2 * S + 3} AND kind = {2 if _direction == 'incoming' else 3}"


@query(f"WITH {NODES}, {EDGES} SELECT n.id, label FROM edges JOIN nodes n ON n.id = CASE WHEN src = {2 * S + 3} THEN dst ELSE src END WHERE kind = 3 AND (src = {2 * S + 3} OR dst = {2 * S + 3})")
def graph_by_kind_both(spark, sf):
    return graph.by_edge_kind(d.nodes(spark, sf), d.edges(spark, sf), 2 * S + 3, 3, "both")


@query(f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def graph_degree(spark, sf):
    return graph.degree(d.edges(spark, sf))


@query(f"WITH RECURSIVE {NODES}, {EDGES}, {hops(CUSTOMER, 3)} SELECT khop.id, CAST(depth AS BIGINT) AS depth FROM khop JOIN nodes USING (id)")
def graph_khop(spark, sf):
    return graph.k_hop(d.nodes(spark, sf), d.edges(spark, sf), CUSTOMER, 3).select("id", F.col("depth").cast("long").alias("depth"))


@query(f"""WITH RECURSIVE {EDGES}, hop AS (SELECT CAST({CUSTOMER} AS BIGINT) AS id, 0 AS depth UNION SELECT adj.other, hop.depth + 1 FROM hop JOIN adj USING (id) WHERE hop.depth < 8),
 lv AS (SELECT id, min(depth) AS depth FROM hop GROUP BY id),
 par AS (SELECT a.other AS id, min(a.id) AS parent FROM adj a JOIN lv p ON p.id = a.id JOIN lv c ON c.id = a.other AND c.depth = p.depth + 1 GROUP BY a.other),
 path AS (SELECT id, depth FROM lv WHERE id = {OTHER} UNION SELECT par.parent, path.depth - 1 FROM path JOIN par USING (id))
 SELECT CAST(depth AS BIGINT) AS position, id FROM path""")
def graph_shortest_path(spark, sf):
    return graph.shortest_path(d.edges(spark, sf), CUSTOMER, OTHER).select(F.col("position").cast("long").alias("position"), "id")


@query(f"""WITH RECURSIVE {NODES}, {EDGES}, {hops(CUSTOMER, 1)}
 SELECT khop.id, label, CAST(depth AS BIGINT) AS depth,
  coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) FROM edges WHERE src = khop.id), '') AS outgoing,
  coalesce((SELECT string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) FROM edges WHERE dst = khop.id), '') AS incoming FROM khop JOIN nodes USING (id)""")
def graph_explore(spark, sf):
    found = graph.explore(d.nodes(spark, sf), d.edges(spark, sf), CUSTOMER, 1)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("id", "label", F.col("depth").cast("long").alias("depth"), text("outgoing"), text("incoming"))


@query(f"WITH {NODES}, {EDGES} SELECT id, label FROM nodes WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = nodes.id OR dst = nodes.id)")
def graph_orphans(spark, sf):
    return graph.orphans(d.nodes(spark, sf), d.edges(spark, sf))


@query(f"WITH {EDGES} SELECT kind, count(*) AS edges FROM edges GROUP BY kind")
def graph_kind_counts(spark, sf):
    return graph.kind_counts(d.edges(spark, sf)).select(F.col("kind").cast("int").alias("kind"), "edges")


@query(f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, CAST(0 AS BIGINT) AS loops")
def graph_stats(spark, sf):
    return graph.stats(d.nodes(spark, sf), d.edges(spark, sf))


@query(f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes WHERE id <> {CUSTOMER}) AS nodes_left, (SELECT count(*) FROM edges WHERE src <> {CUSTOMER} AND dst <> {CUSTOMER}) AS edges_left, (SELECT count(*) FROM edges WHERE src = {CUSTOMER} OR dst = {CUSTOMER}) AS removed")
def graph_remove_node(spark, sf):
    e = d.edges(spark, sf)
    n, left = graph.remove_node(d.nodes(spark, sf), e, CUSTOMER)
    return n.agg(F.count("*").alias("nodes_left")).join(left.agg(F.count("*").alias("edges_left"))).join(graph.touching(e, CUSTOMER).agg(F.count("*").alias("removed")))


@query(f"WITH {EDGES} SELECT kind, count(*) - CASE WHEN kind = 2 THEN (SELECT least(1, count(*)) FROM edges WHERE src = {3 * S + 1} AND kind = 2 AND dst = (SELECT min(dst) FROM edges WHERE src = {3 * S + 1})) ELSE 0 END AS edges FROM edges GROUP BY kind")
def graph_remove_edge(spark, sf):
    e = d.edges(spark, sf)
    end = graph.outgoing(e, 3 * S + 1).agg(F.min("dst")).first()[0]
    return graph.kind_counts(graph.remove_edge(e, 3 * S + 1, end)).select(F.col("kind").cast("int").alias("kind"), "edges")


@query(f"""WITH RECURSIVE {NODES}, {EDGES}, {hops(CUSTOMER, 2)}, v AS (SELECT vec_id + {5 * S} AS id, embedding FROM embeddings),
 s AS (SELECT v.id, v.embedding FROM v JOIN khop USING (id) JOIN nodes USING (id))
 SELECT s.id AS query_id, v.id, round({SIM.format(a='s.embedding', b='v.embedding')}, 6) AS similarity FROM s JOIN v ON s.id <> v.id
 ORDER BY round({SIM.format(a='s.embedding', b='v.embedding')}, 12) DESC, query_id, v.id LIMIT 10""")
def hybrid_query(spark, sf):
    r = hybrid.hybrid(d.nodes(spark, sf), d.edges(spark, sf), d.part_vectors(spark, sf), CUSTOMER, 2, 10)
    return r.similar_vectors.select("query_id", "id", r6("similarity").alias("similarity"))


QUERIES["hybrid"], ORACLES["hybrid"] = QUERIES.pop("hybrid_query"), ORACLES.pop("hybrid_query")

# ---- memories ----


@query(f"WITH {MEMORIES} SELECT id, memory_type, confidence, importance FROM memories WHERE memory_type IN (2, 5) AND confidence >= 2 AND importance >= 2 AND created >= 1700000000 + 6000 ORDER BY id DESC LIMIT 10")
def memory_query(spark, sf):
    from datetime import datetime, timezone

    q = memory.MemoryQuery(memory_types=[2, 5], min_confidence=2, min_importance=2, created_after=datetime.fromtimestamp(1_700_006_000, timezone.utc), limit=10)
    found = memory.query_memories(d.memories(spark, sf), q)
    return found.select("id", F.col("memory_type").cast("long").alias("memory_type"), F.col("confidence").cast("int").alias("confidence"), F.col("importance").cast("long").alias("importance"))


@query(f"WITH {MEMORIES}, e AS (SELECT vec_id AS id, embedding FROM embeddings) SELECT m.id, round({SIM.format(a='q.embedding', b='e.embedding')}, 6) AS similarity FROM memories m JOIN e USING (id), e q WHERE q.id = 1 AND confidence >= 2 ORDER BY similarity DESC, m.id LIMIT 10")
def memory_query_semantic(spark, sf):
    v = d.vectors(spark, sf)
    found = memory.query_memories(d.memories(spark, sf), memory.MemoryQuery(min_confidence=2), v, vectors.vector_of(v, 1))
    return found.select("id", r6("similarity").alias("similarity"))


@query(f"WITH {MEMORIES} SELECT id, CASE WHEN content = 'The' THEN 1.0 WHEN starts_with(content, 'The') THEN 0.8 ELSE 0.6 END::DOUBLE AS relevance FROM memories WHERE contains(content, 'The') ORDER BY relevance DESC, id LIMIT 10")
def memory_recall_text(spark, sf):
    return memory.recall_text(d.memories(spark, sf), "The", 10)


@query("SELECT DISTINCT doc_id AS id FROM documents WHERE list_contains(" + CONCEPTS.format(t="text") + ", 'than')")
def memory_by_concept(spark, sf):
    return memory.by_concept(memory.concept_rows(d.memories(spark, sf)), "Than.", None)


@query(f"WITH {MEMORIES} SELECT id, content FROM memories ORDER BY id DESC LIMIT 5")
def memory_recent(spark, sf):
    return memory.recent(d.memories(spark, sf)).select("id", "content")


_REL = "rel AS (SELECT doc_id AS src, doc_id + 1 AS dst, 7 AS relation FROM documents WHERE doc_id % 10 < 9 UNION ALL SELECT doc_id, doc_id // 2, 6 FROM documents WHERE doc_id % 7 = 0)"


@query(f"""WITH {MEMORIES}, {_REL} SELECT 'type' AS measure, memory_type AS code, count(*)::DOUBLE AS value FROM memories GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM memories GROUP BY 2
 UNION ALL SELECT 'importance', importance, count(*) FROM memories GROUP BY 2 UNION ALL SELECT 'memories', NULL, count(*) FROM memories UNION ALL SELECT 'sessions', NULL, count(DISTINCT session_id) FROM memories
 UNION ALL SELECT 'users', NULL, count(DISTINCT user_id) FROM memories UNION ALL SELECT 'mean_confidence', NULL, round(avg(confidence), 6) FROM memories UNION ALL SELECT 'mean_importance', NULL, round(avg(importance), 6) FROM memories
 UNION ALL SELECT 'relation', relation, count(*) FROM rel GROUP BY 2""")
def memory_statistics(spark, sf):
    return memory.statistics(d.memories(spark, sf), d.relations(spark, sf)).select("measure", "code", r6("value").alias("value"))


@query(f"WITH {MEMORIES}, {_REL} SELECT src, dst, relation FROM rel JOIN memories a ON a.id = src JOIN memories b ON b.id = dst")
def memory_relations(spark, sf):
    m = d.memories(spark, sf).select("id")
    r = d.relations(spark, sf)
    return r.join(m.withColumnRenamed("id", "src"), "src").join(m.withColumnRenamed("id", "dst"), "dst").select("src", "dst", F.col("relation").cast("int").alias("relation"))


@query(f"""WITH RECURSIVE {MEMORIES}, {_REL}, adj AS (SELECT src AS id, dst AS other FROM rel UNION SELECT dst, src FROM rel),
 q AS (SELECT id FROM memories WHERE memory_type = 5 AND confidence = 3), hop AS (SELECT id AS source, id, 0 AS depth FROM q UNION SELECT hop.source, adj.other, hop.depth + 1 FROM hop JOIN adj USING (id) WHERE hop.depth < 2)
 SELECT source, hop.id, CAST(min(depth) AS BIGINT) AS depth FROM hop JOIN memories USING (id) WHERE hop.id <> source GROUP BY source, hop.id""")
def memory_related(spark, sf):
    m = d.memories(spark, sf)
    return memory.related_memories(m.where("memory_type = 5 AND confidence = 3"), m, d.relations(spark, sf), 2).select("source", "id", F.col("depth").cast("long").alias("depth"))


@query(f"WITH {MEMORIES} SELECT id, CASE WHEN id % 3 = 0 THEN 4 ELSE confidence END AS confidence, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS version FROM memories")
def memory_update(spark, sf):
    m = d.memories(spark, sf)
    changes = m.where("id % 3 = 0").select("id", F.lit(4).cast("short").alias("confidence"))
    return memory.update(m, changes).select("id", F.col("confidence").cast("int").alias("confidence"), "version")


@query(f"WITH {MEMORIES} SELECT id, CAST(coalesce(n, 0) AS BIGINT) AS access_count FROM memories LEFT JOIN (SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id) USING (id)")
def memory_access(spark, sf):
    accesses = d.table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts")
    return memory.accessed(d.memories(spark, sf), accesses).select("id", "access_count")


@query(f"WITH c AS (SELECT unnest({CONCEPTS.format(t='text')}) AS concept FROM documents) SELECT concept, count(*) AS documents FROM c GROUP BY concept")
def concept_counts(spark, sf):
    return memory.concept_counts(d.memories(spark, sf))


FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({w}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query(f"WITH c AS (SELECT DISTINCT unnest({CONCEPTS.format(t='text')}) AS concept FROM documents), h AS (SELECT concept, {FNV.format(w='concept')} AS h FROM c) SELECT concept, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN CAST(h::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(h::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT) END AS id FROM h")
def concept_ids(spark, sf):
    return memory.concept_rows(d.memories(spark, sf)).select("concept").distinct().withColumn("id", exprs.concept_id("concept"))


_HELD = f"c AS (SELECT doc_id, unnest({CONCEPTS.format(t='text')}) AS concept FROM documents)"


@query(f"WITH {_HELD}, p AS (SELECT a.concept AS concept, b.concept AS other, count(*) AS texts FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.concept <> b.concept GROUP BY a.concept, b.concept) SELECT concept, count(*) AS partners, CAST(sum(texts) AS BIGINT) AS texts FROM p GROUP BY concept")
def concept_pairs(spark, sf):
    """Of each concept the number of others that it shares a memory with, and of the edges that this gives."""
    return memory.concept_partners(d.table(spark, sf, "documents"), "text")  # memories' contents; nothing else of them is asked for


@query(f"WITH {_HELD} SELECT count(DISTINCT doc_id) AS memories, count(DISTINCT concept) AS concepts, round(count(*) / count(DISTINCT doc_id), 6) AS mean_out_edges FROM c")
def concept_network(spark, sf):
    nodes, edges = memory.concept_graph(d.memories(spark, sf))
    held = graph.by_kind(edges, 2)
    every = nodes.select("id").unionByName(held.select(F.col("src").alias("id")).distinct())
    return graph.concept_network(every, held).select("memories", "concepts", r6("mean_out_edges").alias("mean_out_edges"))


@query(f"WITH {_HELD} SELECT concept AS label FROM c GROUP BY concept HAVING count(*) = count(*) FILTER (doc_id % 2 = 0)")
def memory_forget(spark, sf):
    """Concepts that are lost when the memories with even ids are forgotten."""
    texts = d.memories(spark, sf).select("id", "content")
    nodes, edges = memory.concept_graph(texts)
    kept = memory.forget(texts, texts.select("id"), nodes, edges, texts.where("id % 2 = 0").select("id"))[2]
    return nodes.join(kept, "id", "left_anti").select("label")


@query("SELECT conv_id AS session_id, count(*) AS interactions, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def session_summary(spark, sf):
    return memory.session_summary(d.turns(spark, sf))


@query("SELECT doc_id AS id, CAST(octet_length(encode(text)) >= 1024 AS BOOLEAN) AS large, length(left(text, 32)) AS head FROM documents")
def content_sizes(spark, sf):
    return d.memories(spark, sf).select("id", (F.octet_length("content") >= 1024).alias("large"), F.length(F.substring("content", 1, 32)).cast("long").alias("head"))


@query("WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark), c AS (SELECT item_id, h[2 * i - 1 : 2 * i] AS c FROM (SELECT item_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM b)), n AS (SELECT item_id, c, count(*) AS k FROM c GROUP BY item_id, c), t AS (SELECT item_id, sum(k) AS t FROM n GROUP BY item_id), e AS (SELECT item_id, round(-sum(k / t * log2(k / t)), 6) AS entropy FROM n JOIN t USING (item_id) GROUP BY item_id) SELECT item_id, CASE WHEN h IS NULL THEN NULL ELSE coalesce(entropy, 0) END AS entropy FROM b LEFT JOIN e USING (item_id)")
def byte_entropy(spark, sf):
    """Every row: with accents, empty or null."""
    return d.table(spark, sf, "benchmark").select("item_id", r6(exprs.byte_entropy("text")).alias("entropy"))


# ---- log ----


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def log_fold_latest(spark, sf):
    e = d.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return store.latest_by(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", r6("value").alias("value"))


@query("SELECT event_type, count(*) AS entries, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY event_type")
def log_replay_counts(spark, sf):
    return d.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("entries"), F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq"))


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 1000")
def log_compact(spark, sf):
    return store.compact(d.table(spark, sf, "events"), 1000, "event_id").select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_id = 17")
def log_entry(spark, sf):
    return store.entry(d.table(spark, sf, "events").withColumnRenamed("event_id", "seq"), 17).select(F.col("seq").alias("event_id"), "event_type")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS label FROM events WHERE user_id <> 0 GROUP BY user_id")
def snapshot_recovery(spark, sf):
    """The nodes of a snapshot at the middle of the log, and the tail folded in."""
    e = d.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("event_type").alias("label"))
    middle = e.agg((F.max("seq") / 2).cast("long").alias("m"))
    both = e.join(F.broadcast(middle))  # one row
    snap = store.latest_by(both.where("seq <= m").select("id", "seq", "label"), ["id"], "seq")
    tail = both.where("seq > m").select("id", "seq", "label")
    return store.latest_by(snap.unionByName(tail), ["id"], "seq").where("id <> 0").select("id", "label")


@query("SELECT DISTINCT event_id // 1000 AS snapshot_id FROM events ORDER BY 1 DESC LIMIT 3")
def snapshot_retention(spark, sf):
    ids = d.table(spark, sf, "events").select(F.floor(F.col("event_id") / 1000).alias("snapshot_id")).distinct()
    return store.retained(ids, 3)


# ---- metrics ----

_BOUNDS = ", ".join(f"{b}.0" for b in metrics.BUCKETS)


@query(f"WITH {OPS}, b AS (SELECT unnest([{_BOUNDS}, 'inf'::DOUBLE]) AS bound) SELECT op, bound::DOUBLE AS bound, count(*) FILTER (duration_us <= bound) AS cumulative, count(duration_us) AS total, round(sum(duration_us), 3) AS sum, round(avg(duration_us), 3) AS mean FROM ops, b GROUP BY op, bound")
def metrics_histogram(spark, sf):
    return metrics.histogram(d.operations(spark, sf)).select("op", "bound", "cumulative", "total", F.round("sum", 3).alias("sum"), F.round("mean", 3).alias("mean"))


@query(f"WITH {OPS}, b AS (SELECT unnest([{_BOUNDS}, 'inf'::DOUBLE]) AS bound), h AS (SELECT op, bound::DOUBLE AS bound, count(*) FILTER (duration_us <= bound) AS c, count(duration_us) AS total FROM ops, b GROUP BY op, bound) SELECT op, min(bound) AS bound FROM h WHERE total > 0 AND c >= total * 0.95 GROUP BY op")
def metrics_percentile(spark, sf):
    return metrics.percentile(d.operations(spark, sf), 0.95)


@query(f"WITH {OPS}, w AS (SELECT seq, op, count(*) OVER w AS n, (epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w)) / 1e6 AS s FROM ops WINDOW w AS (PARTITION BY op ORDER BY ts, seq ROWS 59 PRECEDING)) SELECT seq, op, round(CASE WHEN n < 2 OR s <= 0 THEN 0 ELSE n / s END, 6) AS rate FROM w")
def metrics_rate(spark, sf):
    return metrics.rate(d.operations(spark, sf)).select("seq", "op", r6("rate").alias("rate"))


@query(f"WITH {OPS} SELECT op, count(*) AS total, count(*) FILTER (is_error) AS errors, 100.0 * count(*) FILTER (is_error) / count(*) AS error_percent FROM ops GROUP BY op")
def metrics_error_rate(spark, sf):
    return metrics.error_rate(d.operations(spark, sf))


@query(f"WITH {OPS}, c AS (SELECT user_id, 100.0 * count(*) FILTER (is_error) / count(*) AS value FROM ops GROUP BY user_id) SELECT count(*) AS checks, CASE max(CASE WHEN value >= 5 THEN 2 WHEN value >= 1 THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status FROM c")
def health_rollup(spark, sf):
    o = d.operations(spark, sf)
    checks = metrics.error_rate(o.withColumn("op", F.col("user_id"))).select(F.col("op").alias("name"), F.col("error_percent").alias("value"))
    return metrics.health(checks)


@query(f"WITH {OPS}, a AS (SELECT op, duration_us, row_number() OVER (PARTITION BY op ORDER BY ts DESC, seq DESC) - 1 AS age, count(*) OVER (PARTITION BY op) AS n FROM ops) SELECT op, round(sum(duration_us * pow(0.9, age) * CASE WHEN age = n - 1 THEN 1 ELSE 0.1 END), 3) AS ema FROM a GROUP BY op")
def metrics_ema(spark, sf):
    return metrics.ema(d.operations(spark, sf)).select("op", F.round("ema", 3).alias("ema"))


@query("SELECT 'operations_total{op=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_prometheus(spark, sf):
    return metrics.prometheus(metrics.counters(d.operations(spark, sf)))


@query("WITH a AS (SELECT row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS hit FROM events) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 6) AS hit_ratio FROM a")
def cache_hit_ratio(spark, sf):
    """An unbounded cache of (user, event type): a first access misses."""
    e = d.table(spark, sf, "events")
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    hits, total = F.sum(F.col("n") - 1), F.sum("n")
    return n.agg(hits.alias("hits"), (total - hits).alias("misses"), r6(hits / total).alias("hit_ratio"))


@query("SELECT user_id, max(ts) AS last_access FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def cache_ttl(spark, sf):
    e = d.table(spark, sf, "events")
    now = e.agg(F.max("ts")).first()[0]
    return metrics.unexpired(e, "user_id", now, 3600)


# ---- planner ----

_GRID = [("range", 10000, 0.05), ("range", 10000, 0.3), ("complex", 10000, 0.005), ("complex", 8000, 0.1), ("complex", 1000, 0.1), ("point", 10, 0.001), ("similarity", 5000, 1.0), ("similarity", 500, 1.0), ("traversal", 100, 1.0)]
_GRID_SQL = "g(pattern, n, selectivity) AS (VALUES " + ", ".join(f"('{p}', {n}, {s}::DOUBLE)" for p, n, s in _GRID) + ")"


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_GRID, "pattern string, n int, selectivity double")


@query(f"WITH {_GRID_SQL} SELECT pattern, n, selectivity, CASE WHEN pattern = 'point' THEN 'index' WHEN pattern = 'range' THEN CASE WHEN selectivity < 0.1 THEN 'index' ELSE 'scan' END WHEN pattern = 'similarity' THEN CASE WHEN n > 1000 THEN 'vector_index' ELSE 'scan' END WHEN pattern = 'traversal' THEN 'graph' WHEN selectivity < 0.01 THEN 'index' WHEN n > 5000 THEN 'hybrid' ELSE 'scan' END AS strategy FROM g")
def planner_strategy(spark, sf):
    g = _grid(spark).withColumn("cached", F.lit(False))
    return g.select("pattern", "n", "selectivity", planner.strategy().alias("strategy"))


@query(f"WITH {_GRID_SQL} SELECT pattern, n, selectivity, round(n * 100.0::DOUBLE * selectivity, 6) AS linear, round(ln(n) * 50 + n * selectivity * 100.0::DOUBLE * 0.1::DOUBLE, 6) AS indexed, round(n * 500.0::DOUBLE * 64 / 128, 6) AS vector, round(pow(4, 3) * 150.0::DOUBLE, 6) AS graph, ln(n) * 50 + n * selectivity * 100 * 0.1 < n * 100.0 * selectivity AS use_index FROM g")
def planner_cost(spark, sf):
    s = F.col("selectivity")
    return _grid(spark).select("pattern", "n", "selectivity", r6(planner.linear_cost("n", "selectivity")).alias("linear"), r6(planner.index_cost("n", "selectivity")).alias("indexed"), r6(planner.vector_cost("n", 64)).alias("vector"), r6(planner.graph_cost(4, 3)).alias("graph"), (planner.should_use_index("n", "selectivity") & s.isNotNull()).alias("use_index"))


@query("WITH q AS (SELECT user_id % 20 AS query_hash, value * 1000 AS duration_us, event_type = 'view' AS hit FROM events) SELECT query_hash, avg(duration_us) > 1000 AS slow, avg(CASE WHEN hit THEN 0 ELSE 1 END) > 0.3 AS uncached, count(*) > 1000 AS parallel FROM q GROUP BY query_hash")
def planner_recommendations(spark, sf):
    e = d.table(spark, sf, "events")
    return planner.recommendations(e.select((F.col("user_id") % 20).alias("query_hash"), (F.col("value") * 1000).alias("duration_us"), (F.col("event_type") == "view").alias("is_hit")))


@query("SELECT user_id % 20 AS query_hash, count(*) AS runs, round(avg(value), 6) AS mean_us, round(max(value), 6) AS slowest_us FROM events GROUP BY 1")
def planner_recorded(spark, sf):
    e = d.table(spark, sf, "events")
    q = planner.recorded(e.select((F.col("user_id") % 20).alias("query_hash"), F.col("value").alias("duration_us")))
    return q.select("query_hash", "runs", r6("mean_us").alias("mean_us"), r6("slowest_us").alias("slowest_us"))


# ---- placement ----

_LIVE = [1, 2, 3, 4, 5]


def _hash(x: str) -> str:
    a = f"((({x}) % 2147483648 * 1103515245 + 12345) % 2147483648)"
    return f"((xor({a}, {a} >> 15) * 1103515245 + 12345) % 2147483648)"


_RING = f"ring AS (SELECT {_hash('n * 100003 + v * 7919')} AS hash, min(n) AS node_id FROM (SELECT CAST(unnest({_LIVE}) AS BIGINT) AS n), (SELECT unnest(range(0, 150)) AS v) GROUP BY 1)"
_PLACED = f"""{_RING}, k AS (SELECT c_custkey AS key, {_hash('c_custkey')} AS h FROM customer),
 a AS (SELECT key, ring.node_id, row_number() OVER (PARTITION BY key ORDER BY hash < h, hash) AS o FROM k, ring),
 f AS (SELECT key, node_id, min(o) AS o FROM a GROUP BY key, node_id), p AS (SELECT key, list(node_id ORDER BY o)[1:3] AS nodes FROM f GROUP BY key)"""


def _placed(spark, sf):
    return placement.place(d.table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), placement.ring(spark, [*_LIVE, 6], dead=[6]))


@query(f"WITH {_PLACED} SELECT key, nodes[1] AS node_id FROM p")
def ring_placement(spark, sf):
    return _placed(spark, sf).select("key", F.col("nodes")[0].alias("node_id"))


@query(f"WITH {_PLACED} SELECT key, array_to_string(nodes, ',') AS nodes FROM p")
def ring_replicas(spark, sf):
    return _placed(spark, sf).select("key", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query(f"WITH {_PLACED} SELECT nodes[1] AS node_id, count(*) AS items, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY 1")
def ring_load(spark, sf):
    return placement.load(_placed(spark, sf)).select("node_id", "items", r6("share").alias("share"))


@query(f"WITH {_PLACED}, s AS (SELECT count(*) / (SELECT count(*) FROM p) AS share FROM p GROUP BY nodes[1]) SELECT round(max(share) - min(share), 6) AS spread, max(share) - min(share) > 0.15 AS rebalance FROM s")
def ring_rebalance(spark, sf):
    return placement.needs_rebalance(placement.load(_placed(spark, sf))).select(r6("spread").alias("spread"), "rebalance")


def _versions(spark, sf):
    """orders as versions: one per order, keyed by customer, written by a node of the order key."""
    o = d.table(spark, sf, "orders")
    clock = F.map_from_arrays(F.array(*(F.lit(i).cast("long") for i in range(3))), F.array(*((F.col("o_orderkey") * m % 5).cast("long") for m in (1, 2, 3))))
    return o.select(F.col("o_custkey").alias("data_key"), (F.col("o_orderkey") % 7).alias("node_id"), F.col("o_orderkey").alias("ts"), clock.alias("clock"), F.concat(F.col("o_orderstatus"), (F.col("o_orderkey") % 4).cast("string")).alias("value"))


_VERSIONS = "v AS (SELECT o_custkey AS data_key, o_orderkey % 7 AS node_id, o_orderkey AS ts, o_orderkey % 5 AS c0, o_orderkey * 2 % 5 AS c1, o_orderkey * 3 % 5 AS c2, o_orderstatus || (o_orderkey % 4) AS value FROM orders)"


@query(f"WITH {_VERSIONS} SELECT data_key, value FROM v QUALIFY row_number() OVER (PARTITION BY data_key ORDER BY ts DESC, node_id DESC) = 1")
def conflict_latest(spark, sf):
    return placement.resolve_latest(_versions(spark, sf))


@query(f"WITH {_VERSIONS} SELECT data_key, value FROM v QUALIFY row_number() OVER (PARTITION BY data_key ORDER BY node_id DESC, ts DESC) = 1")
def conflict_highest_node(spark, sf):
    return placement.resolve_highest_node(_versions(spark, sf))


@query(f"WITH {_VERSIONS} SELECT data_key, string_agg(DISTINCT value, '|' ORDER BY value) AS value FROM v GROUP BY data_key")
def conflict_merge(spark, sf):
    return placement.resolve_merge(_versions(spark, sf))


@query(f"WITH {_VERSIONS}, u AS (SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.data_key = a.data_key AND b.c0 >= a.c0 AND b.c1 >= a.c1 AND b.c2 >= a.c2 AND b.c0 + b.c1 + b.c2 > a.c0 + a.c1 + a.c2)) SELECT data_key, value FROM u QUALIFY row_number() OVER (PARTITION BY data_key ORDER BY ts DESC, node_id DESC) = 1")
def conflict_clock(spark, sf):
    return placement.resolve_clock(_versions(spark, sf))


@query(f"WITH {_VERSIONS} SELECT data_key, count(DISTINCT value) AS values FROM v GROUP BY data_key HAVING count(DISTINCT value) > 1")
def conflict_manual(spark, sf):
    return placement.resolved_manual(_versions(spark, sf))


def _members(spark, sf):
    """suppliers as cluster members; those in debt are out of reach."""
    s = d.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("node_id"), (F.col("s_acctbal") >= 0).alias("reachable"), F.round("s_acctbal").cast("long").alias("log_index"))


@query("SELECT count(*) AS members, count(*) FILTER (s_acctbal >= 0) AS reachable, CAST(greatest(count(*) // 2 + 1, 2) AS BIGINT) AS needed, count(*) FILTER (s_acctbal >= 0) >= greatest(count(*) // 2 + 1, 2) AS has_quorum FROM supplier")
def quorum_status(spark, sf):
    return placement.quorum(_members(spark, sf))


@query("SELECT count(*) AS members, count(*) FILTER (s_acctbal >= 0) AS healthy, round(count(*) FILTER (s_acctbal >= 0) * 100.0 / count(*), 6) AS healthy_percent, CASE WHEN count(*) FILTER (s_acctbal >= 0) = count(*) THEN 'healthy' WHEN count(*) FILTER (s_acctbal >= 0) >= count(*) // 2 + 1 THEN 'recovering' ELSE 'failed' END AS state FROM supplier")
def cluster_health(spark, sf):
    return placement.cluster_health(_members(spark, sf)).select("members", "healthy", F.round("healthy_percent", 6).cast("double").alias("healthy_percent"), "state")


@query("SELECT s_suppkey AS leader FROM supplier WHERE s_acctbal >= 0 ORDER BY round(s_acctbal) DESC, s_suppkey LIMIT 1")
def leader_choice(spark, sf):
    return placement.leader(_members(spark, sf))


@query("SELECT user_id AS node_id, arg_max(event_type, event_id) AS state, max(event_id) AS incarnation FROM events GROUP BY user_id")
def member_table(spark, sf):
    return placement.member_table(d.table(spark, sf, "events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("state"), F.col("event_id").alias("incarnation")))


# ---- windows of the stream, as a batch ----


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf):
    return streams.windowed(d.table(spark, sf, "events"), "1 hour").select("window_start", "event_type", "events", F.round("total", 3).alias("total"))


# ---- loading, relations, sessions, members ----


@query("SELECT doc_id AS id, min(part) AS source FROM (SELECT doc_id, 1 AS part FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 3 FROM documents) GROUP BY doc_id")
def reload_by_priority(spark, sf):
    """Three overlapping sources of memories; a key comes from the first source that has it."""
    ids = d.table(spark, sf, "documents").select(F.col("doc_id").alias("id")).distinct()
    parts = [ids.where(c).withColumn("source", F.lit(k)) for k, c in ((1, "id % 3 = 0"), (2, "id % 2 = 0"), (3, "true"))]
    return store.reload(parts, "id")


@query(f"SELECT src, dst, 7 AS relation, round(CASE WHEN src % 2 = 0 THEN least(1.0, src % 10 / 5.0) ELSE src % 10 / 10.0 END, 6) AS strength FROM (SELECT o_custkey + {4 * S} AS src, o_orderkey + {6 * S} AS dst FROM orders)")
def relate_memories(spark, sf):
    """Relations with strengths, of which those of even sources are set again, twice as strong, at most 1."""
    e = d.edges(spark, sf).where("kind = 0").select("src", "dst", F.lit(7).alias("relation"), (F.pmod("src", F.lit(10)) / 10).cast("float").alias("strength"))
    again = e.where("src % 2 = 0").withColumn("strength", (F.pmod("src", F.lit(10)) / 5).cast("float"))
    return memory.relate(e, again).select("src", "dst", "relation", r6(F.col("strength").cast("double")).alias("strength"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS title, min(event_id) AS started_at, max(event_id) AS last_active, count(*) AS interaction_count FROM events GROUP BY user_id")
def sessions_latest(spark, sf):
    e = d.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("title"), F.col("event_id").alias("started_at"), F.col("event_id").alias("last_active"), F.lit(1).cast("long").alias("interaction_count"))
    return memory.latest_sessions(e)


@query(f"SELECT e.src, e.dst, e.kind FROM (SELECT l_orderkey + {6 * S} AS src, l_partkey + {5 * S} AS dst, 1 AS kind FROM lineitem) e WHERE e.src IN (SELECT o_orderkey + {6 * S} FROM orders WHERE o_orderstatus = 'F')")
def edge_range_join(spark, sf):
    """The edges of all finished orders."""
    done = d.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(d.node_id("orders", "o_orderkey").alias("id"))
    return store.range_join(d.edges(spark, sf).where("kind = 1"), done).select("src", "dst", F.col("kind").cast("int").alias("kind"))


@query("SELECT event_type AS name, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY event_type")
def metrics_gauges(spark, sf):
    return metrics.gauges(d.table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("ts"), "value")).select("name", r6("value").alias("value"))


@query("SELECT count(*) AS queries, count(DISTINCT user_id) AS patterns, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS hit_ratio, round(avg(value), 6) AS mean_us FROM events")
def planner_statistics(spark, sf):
    q = d.table(spark, sf, "events").select(F.col("user_id").alias("query_hash"), F.col("value").alias("duration_us"), (F.col("event_type") != "error").alias("is_hit"))
    return planner.statistics(q).select("queries", "patterns", r6("hit_ratio").alias("hit_ratio"), r6("mean_us").alias("mean_us"))


@query("WITH e AS (SELECT event_type AS kind, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS later FROM events) SELECT kind, round(sum(value * 0.1 * pow(0.9, later)) + 5 * pow(0.9, count(*)), 6) AS cost FROM e GROUP BY kind")
def planner_adapted(spark, sf):
    q = d.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.col("value").alias("duration_us"))
    return planner.adapted(q, 5.0).select("kind", r6("cost").alias("cost"))


@query("SELECT o_orderkey AS id, (o_orderkey % 5 >= o_custkey % 5) AND (o_orderkey % 5 > o_custkey % 5 OR o_custkey % 3 = 0 OR o_custkey % 3 = o_orderkey % 3) AND (o_orderkey % 4 > o_custkey % 4 OR (o_orderkey % 4 = o_custkey % 4 AND o_orderkey % 7 >= o_custkey % 7)) AS granted, (o_orderkey % 5 >= o_custkey % 5) AND (o_custkey % 2 = 0 OR o_orderkey % 4 = o_custkey % 4) AS accepted, CASE WHEN o_orderkey > 1000 AND o_custkey % 2 = 1 THEN 'fast' ELSE 'replay' END AS recovery FROM orders")
def member_checks(spark, sf):
    """Votes, appended entries and the way of recovery, with orders as messages."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = d.table(spark, sf, "orders").select(
        k.alias("id"), (k % 5).alias("term"), (c % 5).alias("own_term"), F.nullif(c % 3, F.lit(0)).alias("voted"), (k % 3).alias("candidate"), (k % 4).alias("last_term"), (k % 7).alias("last_index"),
        (c % 4).alias("own_last_term"), (c % 7).alias("own_last_index"), (c % 2).alias("prev"), k.alias("gap"), (c % 2 == 1).alias("has_snapshot"),
    )
    granted = placement.grants_vote("term", "own_term", "voted", "candidate", ("last_term", "last_index"), ("own_last_term", "own_last_index"))
    return m.select("id", granted.alias("granted"), placement.accepts_entries("term", "own_term", "prev", "last_term", "own_last_term").alias("accepted"), placement.recovery_mode().alias("recovery"))


@query("SELECT c_custkey AS id, split_part(c_name || chr(0) || 'rest', chr(0), 1) AS label FROM customer")
def label_text(spark, sf):
    return d.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), exprs.label_text(F.concat("c_name", F.lit("\0rest"))).alias("label"))


@query("SELECT user_id AS memory_id, arg_min(event_type, event_id) AS content FROM events GROUP BY user_id")
def first_contents(spark, sf):
    """events as a log of contents; of each user the first."""
    e = d.table(spark, sf, "events")
    log = e.select(F.col("event_id").alias("seq"), F.lit(3).cast("short").alias("entry_type"), F.struct(F.col("user_id").alias("memory_id"), F.col("event_type").alias("content")).alias("memory"), F.lit(False).alias("deleted"))
    return store.first_contents(log)


# ---- functions and operators over whole tables ----


def _signed(h: str) -> str:
    return f"CASE WHEN {h} >= 9223372036854775808::UHUGEINT THEN CAST({h}::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST({h}::HUGEINT AS BIGINT) END"


def _components(*parts: str) -> str:
    h = "14695981039346656037::UHUGEINT"
    for p in parts:
        h = f"((xor({h}, ({p})::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    return h


@query(f"WITH k AS (SELECT o_orderkey AS id, {_components('o_custkey', 'o_orderkey')} AS e, {_components('o_orderkey')} AS n, {_components('o_orderkey % 5', '(o_custkey % 100) * 10', 'o_orderkey')} AS q FROM orders) SELECT id, {_signed('e')} AS edge_key, {_signed('n')} AS node_key, {_signed('q')} AS query_hash FROM k")
def cache_keys(spark, sf):
    """Keys of each order's edge, node and query."""
    o = d.table(spark, sf, "orders").withColumns({"pattern": F.col("o_orderkey") % 5, "selectivity": F.col("o_custkey") % 100 / F.lit(100).cast("decimal(10,0)")})
    return o.select(F.col("o_orderkey").alias("id"), metrics.cache_key("o_custkey", "o_orderkey").alias("edge_key"), metrics.cache_key("o_orderkey").alias("node_key"), planner.query_hash("pattern", "selectivity", "o_orderkey").alias("query_hash"))


@query()
def text_embedding(spark, sf):
    """The features of every memory as a vector, and the checksum of its content."""
    return d.memories(spark, sf).select("id", exprs.text_embed("content").alias("dims"), exprs.checksum("content").alias("checksum"))


@query("WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents) SELECT doc_id AS id, CAST(CASE WHEN len(c) = 0 THEN 0 ELSE 1 + len(list_filter(list_zip(c[:-2], c[2:]), lambda p: p[1] <> p[2])) END AS BIGINT) AS runs, CASE WHEN c IS NOT NULL THEN true END AS same FROM c")
def content_runs(spark, sf):
    """Run-length coding of every memory, and whether it gives the content back."""
    m = d.memories(spark, sf).select("id", "content", exprs.runs("content").alias("coded"))
    return m.select("id", F.size("coded").cast("long").alias("runs"), (exprs.from_runs("coded") == F.col("content")).alias("same"))


@query("WITH b AS (SELECT item_id, text, hex(encode(text)) AS h FROM benchmark), c AS (SELECT item_id, h[2 * i - 1 : 2 * i] AS c FROM (SELECT item_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM b)), n AS (SELECT item_id, c, count(*) AS k FROM c GROUP BY item_id, c), t AS (SELECT item_id, sum(k) AS t FROM n GROUP BY item_id), e AS (SELECT item_id, -sum(k / t * log2(k / t)) AS entropy FROM n JOIN t USING (item_id) GROUP BY item_id) SELECT item_id AS id, round(8 / greatest(1, coalesce(entropy, 0)), 6) AS ratio, length(h) // 2 >= 64 AND 8 / greatest(1, coalesce(entropy, 0)) >= 1.9 AS compress FROM b LEFT JOIN e USING (item_id)")
def content_compression(spark, sf):
    b = d.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("id"), r6(exprs.estimated_ratio("text")).alias("ratio"), exprs.should_compress("text", 64, 1.9).alias("compress"))


@query("SELECT conv_id AS session_id, turn, CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 3 END AS SMALLINT) AS source FROM conversations")
def turn_sources(spark, sf):
    """Names as codes; unknown names get the default."""
    return d.turns(spark, sf).select("session_id", "turn", exprs.code_of("role", {"user": 0, "assistant": 1}, 3).alias("source"))


@query(f"WITH {MEMORIES} SELECT id, session_id, user_id FROM memories WHERE session_id = 3 AND created <= 1700000000 + 36 * 60 AND 1700000000 + id * 61 >= 1700000000 + 31 * 61 AND 1700000000 + id * 61 <= 1700000000 + 38 * 61 ORDER BY id DESC LIMIT 10")
def memory_query_session(spark, sf):
    """Session and the predicates on times."""
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    q = memory.MemoryQuery(session_id=3, created_before=at(36 * 60), accessed_after=at(31 * 61), accessed_before=at(38 * 61))
    return memory.query_memories(d.memories(spark, sf), q).select("id", "session_id", "user_id")


@query(f"WITH {MEMORIES}, {_REL} SELECT id, user_id FROM memories WHERE user_id = 3 AND id IN (SELECT unnest([src, dst]) FROM rel WHERE relation = 6) ORDER BY id DESC LIMIT 10")
def memory_query_relation(spark, sf):
    """User and relation type."""
    q = memory.MemoryQuery(user_id=3, relation_types=[6])
    return memory.query_memories(d.memories(spark, sf), q, relations=d.relations(spark, sf)).select("id", "user_id")


@query(f"WITH {_HELD} SELECT documents.doc_id AS id, text AS content, (SELECT string_agg(concept, ', ' ORDER BY concept) FROM c WHERE doc_id = 7) AS related FROM documents WHERE documents.doc_id = 7")
def memory_recall_id(spark, sf):
    """One memory with its concepts."""
    m = d.memories(spark, sf)
    nodes, edges = memory.concept_graph(m)
    return memory.recall_by_id(m, nodes, edges, 7)


@query(f"WITH {MEMORIES}, n AS (SELECT id + 1000000 AS old, content FROM memories WHERE id % 100 = 0) SELECT count(*) AS memories, max(id) AS last, count(DISTINCT id) AS ids FROM (SELECT id FROM memories UNION ALL SELECT (SELECT max(id) FROM memories) + row_number() OVER (ORDER BY old) FROM n)")
def memory_store(spark, sf):
    """Every hundredth memory stored once more, under new ids."""
    m = d.memories(spark, sf)
    return memory.store(m, m.where("id % 100 = 0")).agg(F.count("*").alias("memories"), F.max("id").alias("last"), F.countDistinct("id").alias("ids"))


@query(f"WITH {NODES}, {EDGES} SELECT 'nodes' AS measure, count(*) AS value FROM nodes WHERE id % 7 <> 0 UNION ALL SELECT 'edges', count(*) FROM edges WHERE kind <> 2 UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'memory_contents', count(*) FROM documents")
def log_fold_state(spark, sf):
    """State as the fold of a log that adds all tables and then drops every seventh node and the edges of kind 2."""
    v = d.vectors(spark, sf).select("id", "dims")
    full = store.State(d.nodes(spark, sf), d.edges(spark, sf), v, d.memories(spark, sf).select(F.col("id").alias("memory_id"), "content"))
    gone = store.State(full.nodes.where("id % 7 = 0"), full.edges.where("kind = 2"), v.limit(0), full.memory_contents.limit(0))
    log = store.as_entries(full, 1).unionByName(store.as_entries(gone, 2).withColumn("deleted", F.lit(True)))
    out = None
    for name, df in store.fold(log)._asdict().items():
        row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {NODES}, {EDGES}, r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) AS rank FROM adj) SELECT id, count(*) AS kept, max(other) AS last FROM r WHERE rank <= 3 GROUP BY id")
def graph_neighbor_cap(spark, sf):
    """Each node's three smallest neighbours."""
    return graph.both_ways(d.edges(spark, sf), 3).groupBy("id").agg(F.count("*").alias("kept"), F.max("other").alias("last"))


@query("SELECT s_suppkey AS node_id FROM supplier WHERE s_acctbal < 0 OR s_suppkey * 7 % 50 > 30")
def members_partitioned(spark, sf):
    """Suppliers as members, last seen some seconds ago."""
    s, now = d.table(spark, sf, "supplier"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    seen = F.timestamp_seconds(F.lit(int(now.timestamp())) - F.col("s_suppkey") * 7 % 50)
    m = s.select(F.col("s_suppkey").alias("node_id"), (F.col("s_acctbal") >= 0).alias("reachable"), seen.alias("last_seen"))
    return placement.partitioned(m, now, 30).select("node_id")


@query(f"WITH {_PLACED}, l AS (SELECT nodes[1] AS node_id, count(*) AS items FROM p GROUP BY 1) SELECT count(*) AS nodes, CAST(sum(items) AS BIGINT) AS items, round(avg(items), 6) AS mean, min(items) AS least, max(items) AS most FROM l")
def ring_partition_statistics(spark, sf):
    return placement.partition_statistics(_placed(spark, sf)).select("nodes", "items", r6("mean").alias("mean"), "least", "most")


@query(f"WITH {_VERSIONS}, p AS (SELECT ts, greatest(c0, 2) AS m0, greatest(c1, 2) AS m1, greatest(c2, 2) AS m2, c0, c1, c2 FROM v) SELECT ts, m0, m1, m2, c1 + 1 AS ticked, CASE WHEN c0 = 2 AND c1 = 2 AND c2 = 2 THEN 'equal' WHEN c0 >= 2 AND c1 >= 2 AND c2 >= 2 THEN 'after' WHEN c0 <= 2 AND c1 <= 2 AND c2 <= 2 THEN 'before' ELSE 'concurrent' END AS standing FROM p")
def clock_functions(spark, sf):
    """Each version's clock merged with and compared with (2, 2, 2), and ticked by node 1."""
    two = F.create_map(*(x for i in range(3) for x in (F.lit(i).cast("long"), F.lit(2).cast("long"))))
    v = _versions(spark, sf).select("ts", "clock", placement.clock_merge(F.col("clock"), two).alias("m"), placement.clock_tick("clock", 1).alias("t"), placement.compare_clocks(F.col("clock"), two).alias("standing"))
    at = lambda c, i: F.element_at(c, F.lit(i).cast("long"))
    return v.select("ts", *(at("m", i).alias(f"m{i}") for i in range(3)), at("t", 1).alias("ticked"), "standing")


@query("SELECT event_id AS id, round(value * CASE event_type WHEN 'view' THEN 1.2 WHEN 'click' THEN 0.8 ELSE 1 END, 6) AS cost, round(1.0::DOUBLE / (value * 0.1::DOUBLE + 0.001::DOUBLE), 6) AS priority FROM events")
def planner_plan_cost(spark, sf):
    """Events as plans: views hybrid, clicks custom."""
    kind = F.when(F.col("event_type") == "view", "hybrid").when(F.col("event_type") == "click", "custom").otherwise("scan")
    e = d.table(spark, sf, "events").select(F.col("event_id").alias("id"), kind.alias("strategy"), F.col("value").alias("cost"))
    return e.select("id", r6(planner.plan_cost()).alias("cost"), r6(planner.priority("cost", 0.1)).alias("priority"))


@query("SELECT event_type AS key, count(*) AS value FROM events GROUP BY event_type")
def map_reduce_counts(spark, sf):
    """The caller's own functions over batches, combined before the exchange."""

    def mapper(batch):
        import pandas as pd

        return pd.DataFrame({"key": batch["event_type"], "value": 1})

    def reducer(own):
        import pandas as pd

        return pd.DataFrame({"key": own["key"].iloc[:1], "value": [own["value"].sum()]})

    ship(spark)
    return custom.map_reduce(d.table(spark, sf, "events").select("event_type"), mapper, reducer, "key string, value long", combine=True)


@query("SELECT event_id AS id, round(value * 2, 6) AS twice FROM events")
def batch_processing(spark, sf):
    def twice(batch):
        import pandas as pd

        return pd.DataFrame({"id": batch["event_id"], "twice": (batch["value"] * 2).round(6)})

    ship(spark)
    return custom.process_batches(d.table(spark, sf, "events").select("event_id", "value"), twice, "id long, twice double")


@query("SELECT count(*) AS submitted, count(*) FILTER (event_type <> 'error') AS completed, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS completion_rate, round(avg(event_id % 10 + 1) FILTER (event_type <> 'error'), 6) AS mean_us FROM events")
def pool_statistics(spark, sf):
    """Events as tasks, of which the errors never ended."""
    i = F.col("event_id")
    t = d.table(spark, sf, "events").select((i * 3).alias("started_us"), F.when(F.col("event_type") != "error", i * 3 + i % 10 + 1).alias("ended_us"))
    return custom.pool_statistics(t, 8).select("submitted", "completed", r6("completion_rate").alias("completion_rate"), r6("mean_us").alias("mean_us"))


@query("SELECT '{\"op\":\"' || event_type || '\",\"count\":' || count(*) || '}' AS line FROM events GROUP BY event_type")
def metrics_json(spark, sf):
    return metrics.json_export(metrics.counters(d.operations(spark, sf)))
