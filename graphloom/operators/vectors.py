"""Vector operators over vectors(id, dims): cosine search, threshold search, statistics, clustering, quantisation, an IVF index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.exprs import cosine, l2_norm
from graphloom.sources.lineage import cut

THRESHOLD, CLUSTER_ITERATIONS = 0.5, 100
#: Rows of a query block and of a data block of the blocked search.
QUERY_BLOCK, DATA_BLOCK = 4096, 16384


def with_norm(vectors: DataFrame) -> DataFrame:
    """Norms once, so that a cosine is one product."""
    return vectors.withColumn("norm", l2_norm("dims"))


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", l2_norm("dims").alias("magnitude"))


def _literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def vector_of(vectors: DataFrame, vector_id: int) -> list[float]:
    row = vectors.where(F.col("id") == vector_id).select("dims").first()
    if row is None:
        raise KeyError(f"no vector {vector_id}")
    return list(row.dims)


def scored(vectors: DataFrame, query: Sequence[float], skip: int | None = None) -> DataFrame:
    """(id, similarity) to a literal query."""
    norm = float(np.sqrt(np.sum(np.square(np.array(query, "f8")))))
    own = vectors if skip is None else vectors.where(F.col("id") != skip)
    return own.select("id", cosine("dims", _literal(query), norm_b=F.lit(norm)).alias("similarity"))


def top_k_of(vectors: DataFrame, query: Sequence[float], k: int, skip: int | None = None) -> DataFrame:
    return scored(vectors, query, skip).orderBy(F.desc("similarity"), "id").limit(k)


def top_k(vectors: DataFrame, vector_id: int, k: int) -> DataFrame:
    """The k most similar others; raises for an unknown id. A top-k per partition, merged."""
    return top_k_of(vectors, vector_of(vectors, vector_id), k, vector_id)


def threshold(vectors: DataFrame, vector_id: int, least: float = THRESHOLD) -> DataFrame:
    """All others at least as similar as ``least``."""
    return scored(vectors, vector_of(vectors, vector_id), vector_id).where(F.col("similarity") >= least)


def _cells(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Data and queries dealt to cells: each block of queries meets each block of data in one bounded task."""
    q_blocks, d_blocks = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // DATA_BLOCK))
    deal = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    data = vectors.select("id", "dims", deal(d_blocks).alias("d"), every(q_blocks).alias("q"))
    asks = queries.select(F.col("id").alias("ask"), F.col("dims").alias("ask_dims"), deal(q_blocks).alias("q"), every(d_blocks).alias("d"))
    return data, asks


def _similarities(asks: pd.DataFrame, data: pd.DataFrame) -> np.ndarray:
    a, b = (np.array(x.tolist(), "f8").reshape(len(x), -1) for x in (asks["ask_dims"], data["dims"]))
    na, nb = (np.sqrt((x * x).sum(axis=1)) for x in (a, b))
    scale = np.where(na == 0, 0, 1 / np.where(na == 0, 1, na))[:, None] * np.where(nb == 0, 0, 1 / np.where(nb == 0, 1, nb))
    return (a @ b.T) * scale


def search(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, id, similarity): for each row of queries(id, dims) its k most similar, or all at least as similar as ``least``, itself left out.

    Blocks meet in cells by a matrix product over Arrow batches; each cell keeps k rows per query, and a window merges them.
    """
    data, asks = _cells(vectors, queries)

    def cell(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, "i8"), "id": np.empty(0, "i8"), "similarity": np.empty(0)})
        if not len(d) or not len(q):
            return empty
        ids, out = d["id"].to_numpy(), []
        for at in range(0, len(q), 512):
            part = q.iloc[at : at + 512]
            s = _similarities(part, d)
            for own, row in zip(part["ask"].to_numpy(), s):
                hit = np.flatnonzero(ids != own)
                if least is not None:
                    hit = hit[row[hit] >= least]
                if k is not None and len(hit) > k:
                    # rounded, so that sums in another order don't tell ties apart
                    hit = hit[np.lexsort((ids[hit], -np.round(row[hit], 12)))[:k]]
                out.append(pd.DataFrame({"query_id": own, "id": ids[hit], "similarity": row[hit]}))
        return pd.concat(out) if out else empty

    found = data.groupBy("q", "d").cogroup(asks.groupBy("q", "d")).applyInPandas(cell, "query_id long, id long, similarity double")
    if k is None:
        return found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def batch_top_k(vectors: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Top-k for each id of ids(id); raises if one is unknown."""
    missing = ids.join(vectors, "id", "left_anti")
    if not missing.isEmpty():
        raise KeyError(f"no vector {missing.first().id}")
    return search(vectors, vectors.join(ids, "id", "left_semi"), k=k)


def centroid(vectors: DataFrame, ids: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(…by, position, mean): the mean by component; repeated ids count again."""
    own = vectors if ids is None else vectors.join(ids, "id")
    return own.select(*by, F.posexplode("dims").alias("position", "x")).groupBy(*by, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroids(vectors: DataFrame, by: Sequence[str]) -> DataFrame:
    """(…by, centroid, members)."""
    parts = vectors.select(*by, "id", F.posexplode("dims").alias("position", "x")).groupBy(*by, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("members"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda s: s["mean"]).alias("centroid"), F.max("members").alias("members"))


def similarity_matrix(vectors: DataFrame, ids: Sequence[int]) -> DataFrame:
    """(a, b, similarity) for a stated list of ids: 1 on the diagonal, 0 where one is unknown."""
    spark = vectors.sparkSession
    names = spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")
    own = F.broadcast(names.join(vectors, "id", "left").select("id", "dims"))  # as many rows as ids are stated
    pairs = own.select(F.col("id").alias("a"), F.col("dims").alias("x")).crossJoin(own.select(F.col("id").alias("b"), F.col("dims").alias("y")))
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(cosine("x", "y"), F.lit(0.0))).alias("similarity"))


def neighbor_statistics(found: DataFrame) -> DataFrame:
    """Count, mean, max, min and population deviation of each query's similarities."""
    s = F.col("similarity")
    return found.groupBy("query_id").agg(F.count("*").alias("neighbors"), F.avg(s).alias("mean"), F.max(s).alias("max"), F.min(s).alias("min"), F.stddev_pop(s).alias("std"))


def k_means(vectors: DataFrame, k: int, iterations: int = CLUSTER_ITERATIONS) -> tuple[DataFrame, list[list[float]]]:
    """((id, cluster), centroids): cosine k-means from the first k vectors by id (repeating the first if there are fewer).

    Ties go to the lower cluster, an empty cluster keeps its centroid, and rounds end early once no assignment changes. The driver
    holds k centroids; each round is one aggregation by (cluster, position).
    """
    base = vectors.select("id", "dims")
    first = [list(map(float, r.dims)) for r in base.orderBy("id").limit(k).collect()]
    if not first:
        return base.select("id", F.lit(0).alias("cluster")), []
    centres = first + [first[0]] * (k - len(first))
    before = None
    for _ in range(max(1, iterations)):
        marked = assign(base, centres)
        state = marked.agg(F.sum(F.xxhash64("id", "cluster").cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
        before = state
        means = marked.select("cluster", F.posexplode("dims").alias("position", "x")).groupBy("cluster", "position").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()  # k rows a position
        new = [list(c) for c in centres]
        for r in means:
            new[r.cluster][r.position] = r.m
        centres = new
    return assign(base, centres).select("id", "cluster"), centres


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The column's vectors as rows in double precision, and which are whole: of that width, all finite. Others are zero rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    whole, flat = sizes == width, column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    out = np.zeros((len(sizes), width))
    out[whole] = flat[np.repeat(whole, sizes)].reshape(int(whole.sum()), width)
    whole &= np.isfinite(out).all(axis=1)
    out[~whole] = 0
    return out, whole


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    norm = np.sqrt((rows * rows).sum(axis=1))[:, None]
    return rows / np.where(norm == 0, 1, norm)


def _placed(vectors: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """vectors with ``cluster``, the cosine to its centre ``own`` (not a number if the vector isn't whole) and ``zero``, by matrix products over Arrow batches."""
    rest = [c for c in vectors.columns if c not in ("cluster", "own", "zero")]
    source = vectors.select(*rest)
    width = len(centres[0])
    units = _units(np.array(centres, "f8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, whole = _matrix(batch.column(rest.index("dims")), width)
            # rounded, so that sums in another order don't tell ties apart; the first of equal ones counts
            s = np.round(_units(x) @ units.T, 12)
            best = s.argmax(axis=1)
            own = np.where(whole, s[np.arange(len(s)), best], np.nan)
            new = [pa.array(best.astype("i4")), pa.array(own, from_pandas=False), pa.array(whole & ~x.any(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*rest, "cluster", "own", "zero"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("own", T.DoubleType()), T.StructField("zero", T.BooleanType())]))


def assign(vectors: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """vectors with the cluster of the most similar centre (the first, for vectors that aren't whole)."""
    return _placed(vectors, centres).drop("own", "zero")


def quantize(vectors: DataFrame) -> DataFrame:
    """(id, codes, low, step): 8-bit codes over the whole table's range; ``dequantize`` is the inverse up to one step."""
    span = vectors.agg(F.min(F.array_min("dims")).cast("double").alias("low"), F.max(F.array_max("dims")).cast("double").alias("high"))
    step = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / 255.0).otherwise(1.0)
    rows = vectors.join(F.broadcast(span.select("low", step.alias("step"))))  # one row
    codes = F.transform("dims", lambda x: F.least(F.lit(255), F.floor((x.cast("double") - F.col("low")) / F.col("step")).cast("int")).cast("short"))
    return rows.select("id", codes.alias("codes"), "low", "step")


def dequantize(codes: DataFrame) -> DataFrame:
    return codes.select("id", F.transform("codes", lambda c: (c * F.col("step") + F.col("low")).cast("float")).alias("dims"))


class Ivf:
    """An inverted-file index: vectors by their k-means cell. A search probes the cells nearest to the query and ranks exactly."""

    def __init__(self, vectors: DataFrame, cells: int = 16, iterations: int = 5, sample: int = 50_000):
        # centres are fitted to at most ``sample`` vectors (those of the smallest hashes); every vector is indexed
        fitted = vectors.orderBy(F.xxhash64("id"), "id").limit(sample)
        self.centres = k_means(cut(fitted), cells, iterations)[1]
        self.rows = cut(_placed(vectors.select("id", "dims"), self.centres)) if self.centres else vectors.select("id", "dims", F.lit(0).alias("cluster"), F.lit(0.0).alias("own"), F.lit(True).alias("zero"))

    def stats(self) -> DataFrame:
        return self.rows.groupBy("cluster").agg(F.count("*").alias("vectors"))

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(query_id, id, similarity, rank), each query itself left out before the cut to k.

        The nearest ``probes`` cells come first. A further cell is searched unless the angles say that none of its vectors can
        beat the k-th found so far, so that the result is that of a search of every cell. A cell's vectors meet the queries that
        probe it in blocks, by a matrix product. Vectors that hold null or non-finite components are near to nothing.
        """
        similar = F.array(*(F.struct(cosine("dims", _literal(c)).alias("s"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)))
        near = F.slice(F.sort_array(similar, asc=False), 1, probes)
        asked = cut(queries.select(F.col("id").alias("query_id"), F.col("dims").alias("query"), near.alias("near"), similar.alias("similar")))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id"))
        q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        # as many blocks of data in each cell as it needs: a number for each cell
        sizes = {r.cluster: r.vectors for r in self.stats().collect()}
        d_blocks = F.element_at(F.array(*(F.lit(max(1, -(-sizes.get(i, 0) // DATA_BLOCK))) for i in range(len(self.centres) or 1))), F.col("cluster") + 1)
        deal = lambda c, of: F.pmod(F.xxhash64(c), of).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
        data = self.rows.select("id", "dims", "cluster", deal("id", d_blocks).alias("d"), every(F.lit(q_blocks)).alias("q"))
        keys, width = ("cluster", "d", "q"), len(self.centres[0]) if self.centres else 0

        def cell(rows: pa.Table, asks: pa.Table) -> pa.Table:
            (b, whole_b), (a, whole_a) = _matrix(rows.column("dims"), width), _matrix(asks.column("query"), width)
            ids, b = rows.column("id").to_numpy()[whole_b], _units(b[whole_b])
            own, a = asks.column("query_id").to_numpy()[whole_a], _units(a[whole_a])
            found = [(np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))]
            for at in range(0, len(a) if len(b) else 0, 256):
                exact, mine = a[at : at + 256] @ b.T, own[at : at + 256]
                s = np.where(mine[:, None] == ids, -np.inf, np.round(exact, 12))
                least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(s), -np.inf)
                r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                order = np.lexsort((ids[c], -s[r, c], r))
                r, c = r[order], c[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k  # the k first of each query
                found.append((mine[r[first]], ids[c[first]], exact[r[first], c[first]]))
            return pa.table(dict(zip(("query_id", "id", "similarity"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

        def best(asks: DataFrame, also: DataFrame | None = None) -> DataFrame:
            dealt = asks.select("query_id", "query", "cluster", every(d_blocks).alias("d"), deal("query_id", F.lit(q_blocks)).alias("q"))
            pairs = data.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(cell, "query_id long, id long, similarity double")
            return (pairs if also is None else pairs.unionByName(also)).withColumn("rank", rank).where(F.col("rank") <= k)

        first = cut(best(asked.select("query_id", "query", F.explode(F.transform("near", lambda x: x["i"])).alias("cluster"))).drop("rank"))
        floor = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("floor"))
        rest = asked.select("query_id", "query", F.explode(F.array_except("similar", "near")).alias("c")).select("query_id", "query", F.col("c.i").alias("cluster"), F.col("c.s").alias("s"))
        # no vector of a cell is nearer to the query than the angle to its centre less the cell's widest angle
        widest = self.rows.groupBy("cluster").agg(F.max(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("own") - 1e-11)))).alias("wide"), F.max("zero").alias("zeros"))
        angle = F.greatest(F.lit(0.0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s")))) - F.col("wide"))
        open_ = F.col("floor").isNull() | F.col("zeros") | F.isnan("wide") | (F.col("s") == 0) | (F.cos(angle) + 1e-9 >= F.col("floor"))
        further = rest.join(F.broadcast(widest), "cluster").join(floor, "query_id", "left").where(open_).select("query_id", "query", "cluster")  # a row for each cell
        return best(further, first)


def latest(versions: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last version of each key: an aggregation with partial results, no sort of hot keys."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")

