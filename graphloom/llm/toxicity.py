"""Toxicity by a classifier chain of linear models over features of words and their beginnings.

The chain predicts its categories in order. Each is a logistic model over word presence, and each later model also gets the
earlier categories' probabilities (as log-odds). For training these come from out-of-fold predictions, so that a later model
sees probabilities of the same kind as at prediction time, where they come from models fitted to the whole sample.

A feature is a whole word or the first 3 to 7 letters of words; its value in a document grows with its count and with its share of
the words, up to 1. Training rows, pairs of a text and its labels, are a sample of the labelled documents, bounded by ``MOST_ROWS`` (the smallest hashes of doc_id);
features are those whose presence goes with a category significantly (chi-square at least ``LEAST_CHI2`` and at least ``LEAST_DOCS``
documents), at most ``MOST_FEATURES`` for each category. Feature statistics and features of the sample are made by the executors; the driver gets the
chosen words and, for each sampled document, the numbers of its features. Every document is scored over its whole text.

Nulls and odd input: a null text counts as empty; null doc_ids and repeated rows are scored as rows; labels that are null, or whose
doc_id is null or not among the documents, train nothing; a category without both outcomes in the sample gets its base rate
(0 without any labels) for all documents; empty tables give empty results; further columns are ignored by ``score`` and
kept by ``without_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: The chain: category, label column, and the label's value that means it.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
MOST_ROWS, MOST_FEATURES, LEAST_CHI2, LEAST_DOCS, FOLDS, THRESHOLD = 6_000, 1_000, 24.0, 4, 3, 0.5
STARTS, HELD = range(3, 8), 150_000
_WORDS = re.compile(r"[^\W_]+").findall


def features(text: str) -> set[str]:
    """All features of a text: beginnings, and whole words with a closing mark."""
    own = set(_WORDS(text.lower()))
    return {w[:k] for w in own for k in STARTS if len(w) >= k} | {w + "$" for w in own}


def values(text: str, vocabulary: dict[str, int], heads: set[str]) -> tuple[list[int], list[float]]:
    """Numbers and values of a text's features that are in the vocabulary; heads: the first three characters of its keys."""
    own = _WORDS(text.lower())
    found: dict[int, int] = {}
    for w, n in Counter(own).items():
        if w[:3] in heads or w + "$" in vocabulary:
            for f in (*(w[:k] for k in STARTS if len(w) >= k), w + "$"):
                if (c := vocabulary.get(f)) is not None:
                    found[c] = found.get(c, 0) + n
    cols = sorted(found)
    return cols, [min(1.0, 50 * found[c] / len(own)) * min(1.0, found[c] / 2) for c in cols]


def sparse(found: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of documents' features."""
    return np.repeat(np.arange(len(found)), [len(c) for c, _ in found]), np.array([c for cols, _ in found for c in cols], "i8"), np.array([v for _, vals in found for v in vals], "f8")


class Linear(NamedTuple):
    """A logistic model: a bias, weights of the word features, weights of the earlier categories' log-odds."""

    bias: float
    weights: np.ndarray
    chained: np.ndarray

    def predict(self, x: tuple, n: int, before: np.ndarray) -> np.ndarray:
        rows, cols, vals = x
        z = self.bias + np.bincount(rows, weights=self.weights[cols] * vals, minlength=n) + before @ self.chained
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: tuple, n: int, size: int, before: np.ndarray, y: np.ndarray, penalty: float = 1e-4, turns: int = 200) -> Linear:
    """Logistic regression by accelerated gradient steps, scaled by each feature's mean square; a constant if y has one outcome."""
    rate = float(y.mean()) if n else 0.0
    if not 0 < rate < 1:
        return Linear(30.0 if rate else -30.0, np.zeros(size), np.zeros(before.shape[1]))
    rows, cols, vals = x
    step_w = 1 / (np.bincount(cols, weights=vals**2, minlength=size) / n + 0.003)
    step_c = 1 / ((before**2).mean(axis=0) + 0.1)
    w, c, b = np.zeros(size), np.zeros(before.shape[1]), math.log(rate / (1 - rate))
    vw, vc, vb = w.copy(), c.copy(), b
    for t in range(turns):
        err = Linear(vb, vw, vc).predict(x, n, before) - y
        nw = vw - step_w * (np.bincount(cols, weights=err[rows] * vals, minlength=size) / n + penalty * vw) * 0.2
        nc = vc - step_c * (err @ before / n + penalty * vc) * 0.2
        nb = vb - err.mean()
        k = min(0.9, t / (t + 3))
        vw, vc, vb = nw + k * (nw - w), nc + k * (nc - c), nb + k * (nb - b)
        w, c, b = nw, nc, nb
    return Linear(b, w, c)


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Chain(NamedTuple):
    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    models: tuple[Linear, ...]

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """texts x categories probabilities."""
        heads = {f[:3] for f in self.vocabulary}
        x, n = sparse([values(t, self.vocabulary, heads) if t else ([], []) for t in texts]), len(texts)
        before, out = np.zeros((n, 0)), np.zeros((n, 0))
        for m in self.models:
            p = m.predict(x, n, before)
            before, out = np.column_stack([before, odds(p)]), np.column_stack([out, p])
        return out


def part(x: tuple, keep: np.ndarray) -> tuple:
    """The kept documents' features, renumbered."""
    rows, cols, vals = x
    use = keep[rows]
    return (np.cumsum(keep) - 1)[rows[use]], cols[use], vals[use]


def fit_chain(x: tuple, labels: np.ndarray, fold: np.ndarray, size: int) -> tuple[Linear, ...]:
    """The chain's models; labels n x categories. Later models are trained on out-of-fold probabilities of the earlier ones."""
    n, models, before = len(labels), [], np.zeros((len(labels), 0))
    for c in range(labels.shape[1]):
        y, out_of_fold = labels[:, c], np.zeros(n)
        models.append(fit(x, n, size, before, y))
        if c + 1 < labels.shape[1]:
            for k in range(FOLDS):
                own = fold == k
                m = fit(part(x, ~own), int((~own).sum()), size, before[~own], y[~own])
                out_of_fold[own] = m.predict(part(x, own), int(own.sum()), before[own])
            before = np.column_stack([before, odds(out_of_fold)])
    return tuple(models)


def train(docs: DataFrame, labels: DataFrame, chain: Sequence[tuple] = CHAIN, most_rows: int = MOST_ROWS) -> Chain:
    """Fits the chain to at most ``most_rows`` labelled documents."""
    names = [f"y{k}" for k in range(len(chain))]
    outcome = [(F.col(column) == value).cast("int").alias(n) for n, (_, column, value) in zip(names, chain, strict=True)]
    chosen = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *outcome).dropna().orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(most_rows)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # a doc_id may have many rows and labels: the bound is that of the rows that train, equal ones counted once
    met = known.select("doc_id", "tie").join(F.broadcast(cut(chosen)), "doc_id").distinct()
    rows = cut(met.orderBy(F.xxhash64("doc_id"), "doc_id", "tie", *names).limit(most_rows))
    texts = known.join(F.broadcast(rows.select("doc_id", "tie").distinct()), ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"])
    sample = cut(texts.join(F.broadcast(rows), ["doc_id", "tie"]).select("doc_id", "text", F.array(*names).alias("y")))  # both broadcasts are bounded by most_rows

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flushed():
            rows = list(seen.items())
            seen.clear()
            for at in range(0, len(rows), 50_000):
                (pairs, n) = zip(*rows[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([f for _, f in pairs]), pa.array([y for y, _ in pairs]), pa.array(n, pa.int64())], ["word", "y", "n"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                label = "".join(map(str, y))
                seen.update((label, f) for f in features(text))
                if len(seen) > HELD:  # partial counts are summed after the shuffle; a task holds no more than these
                    yield from flushed()
        yield from flushed()

    total = {r.y: r["count"] for r in sample.select(F.array_join(F.col("y").cast("array<string>"), "").alias("y")).groupBy("y").count().collect()}
    size = sum(total.values())
    per = sample.select("text", "y").mapInArrow(counts, "word string, y string, n long").groupBy("word").agg(
        F.sum("n").alias("docs"), *(F.sum(F.when(F.substring("y", k + 1, 1) == "1", F.col("n")).otherwise(0)).alias(f"with{k}") for k in range(len(chain)))
    )
    vocabulary: dict[str, int] = {}
    for k in range(len(chain)):
        positive = sum(n for y, n in total.items() if y[k] == "1")
        if not 0 < positive < size:
            continue
        a, d = F.col(f"with{k}").cast("double"), F.col("docs").cast("double")
        chi2 = size * F.pow(a * size - d * positive, 2) / (d * F.greatest(size - d, F.lit(0.5)) * positive * (size - positive))
        best = per.select("word", "docs", chi2.alias("chi2")).where((F.col("docs") >= LEAST_DOCS) & (F.col("chi2") >= LEAST_CHI2)).orderBy(F.desc("chi2"), "word").limit(MOST_FEATURES).collect()
        for r in best:
            vocabulary.setdefault(r.word, len(vocabulary))

    heads = {f[:3] for f in vocabulary}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [values(x, vocabulary, heads) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64())), batch.column(2)], ["doc_id", "cols", "vals", "y"])

    data = sorted(sample.select("doc_id", "text", "y").mapInArrow(numbered, "doc_id long, cols array<int>, vals array<double>, y array<int>").collect())
    x = sparse([(r.cols, r.vals) for r in data])
    y = np.array([r.y for r in data], "f8").reshape(len(data), len(chain))
    fold = np.array([r.doc_id * 0x9E3779B1 % (1 << 32) % FOLDS for r in data])
    return Chain(tuple(c for c, _, _ in chain), vocabulary, fit_chain(x, y, fold, len(vocabulary)))


def score(docs: DataFrame, model: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_<category>..., toxic) of every row; toxic: the last category's probability is at least the threshold."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_FEATURES for each category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for batch in batches:
            p = m.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", *(f"p_{c}" for c in m.categories)])

    schema = ", ".join(["doc_id long", *(f"p_{c} double" for c in model.categories)])
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return scored.withColumn("toxic", F.col(f"p_{model.categories[-1]}") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not toxic, in their columns. Rows are scored where they are, without a join."""
    spread = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for batch in batches:
            yield batch.filter(pa.array(m.predict(batch.column(at).to_pylist())[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
