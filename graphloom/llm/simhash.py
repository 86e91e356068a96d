"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a few differing bits by pigeonring filtering.

Fingerprint. Lower-case A-Z, take the words between ASCII white space, join each run of ``shingle`` consecutive words by
single spaces (repeats included; fewer words: the whole sequence) and hash it with XXH64, seed 42. A bit is 1 if it is set in
over half of the hashes. No words: fingerprint 0, which links like any other.

Pigeonring. The 64 bits are a ring of 16 segments of 4 bits. If two fingerprints differ in at most 3 bits, some start on the
ring exists from which every chain of l segments differs in at most floor(3 l / 16) bits: the first 5 segments are equal
(the join key: start and 20 bits), the first 10 differ in at most 1 bit, the first 15 in at most 2, all 16 in at most 3.
The chain conditions prune the pairs that share a key; the last is the full Hamming check.

Scale. Equal fingerprints are one vertex. Each distinct fingerprint goes to 16 keys; a key with over ``CELL`` fingerprints is
dealt as pairs of chunks to many cells, so that no task gets an unbounded group. Tasks emit spanning stars, never all pairs.

Nulls and odd input: a null text counts as empty (no words, fingerprint 0); a null doc_id keeps its row with a fingerprint
and a null component and links with nothing; repeated doc_ids keep their rows; an empty table gives an empty result; further
columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import Stars, components, cut, table, whole_runs

SEED, BITS, SEGMENTS = 42, 64, 16
#: Most fingerprints of one key that meet in one cell at once (twice that in a cell of two chunks).
CELL = 2048
#: The wide fingerprints of ``keep_one``: bits; bits of a segment; leading segments that are equal; differing bits at most. Texts
#: at a similarity of 0.8 differ in 0.15 of the bits (116, standard deviation 10), so some start has 20 equal bits for 97 % of them.
WIDE, SEGMENT, EQUAL, MOST_BITS = 768, 4, 5, 144
_TURNS = np.arange(1, WIDE // 64 + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
#: The bits of each byte, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1).view("u8").ravel()
#: Texts that each is compared with in the first round; parts of a hot value in joins; one text in so many tells hot cells.
FRONT, SPREAD, SAMPLE = 1, 16, 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of one text in UTF-8."""
    words = text.lower().split()  # bytes: lowers A-Z only and splits at ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    starts = np.cumsum([0, *map(len, words)])[:-1] + np.arange(len(words))
    ends = starts + np.fromiter(map(len, words), "i8", len(words))
    a, b = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    h = np.fromiter(map(xxh64_intdigest, [line[i:j] for i, j in zip(a, b, strict=True)], repeat(SEED)), "u8", len(a))
    # 2,048 rows of bits at a time: a long text needs no more memory than a short one
    ones = np.zeros(BITS, "i8")
    for at in range(0, len(h), 2048):
        ones += np.unpackbits(h[at : at + 2048].astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(x.as_buffer() and x.as_buffer().to_pybytes() or b"", shingle) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, "u8").view("i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def chains(x: np.ndarray, start: np.ndarray, most: int = 3) -> np.ndarray:
    """Whether the differing bits x (uint64), read from segment ``start`` on, keep every chain's budget floor(most * l / 16)."""
    left = (4 * start).astype("u8")
    turned = np.where(left > 0, (x << left) | (x >> (np.uint64(BITS) - np.maximum(left, 1).astype("u8"))), x)
    ok = np.ones(len(x), bool)
    for length in range(1, SEGMENTS + 1):
        if length == SEGMENTS or most * (length + 1) // SEGMENTS > most * length // SEGMENTS:  # the budget's steps imply the rest
            ok &= np.bitwise_count(turned >> np.uint64(BITS - 4 * length)) <= most * length // SEGMENTS
    return ok


def _linked(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = Stars()
        for t in whole_runs(batches, "cell"):
            cell, start, fp, rep = (t.column(c).to_numpy() for c in ("cell", "start", "fp", "rep"))
            bits, i, d = fp.view("u8"), np.arange(len(cell)), 0
            while len(i):  # pairs of one cell, one distance in the run at a time: memory grows with the rows, not the pairs
                d += 1
                i = i[i + d < len(cell)]
                i = i[cell[i] == cell[i + d]]
                hit = i[chains(bits[i] ^ bits[i + d], start[i], most)] if len(i) else i
                stars.add(rep[hit], rep[hit + d])
        a, b = stars.edges()
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], ["a", "b"])

    return run


def links(reps: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) between the ids of reps(fp, rep) that join all fingerprints at ``most`` or fewer differing bits, as spanning stars."""
    equal = next(n for n in range(1, SEGMENTS + 1) if most * (n + 1) // SEGMENTS >= 1)  # leading segments without any difference
    width = 4 * equal
    wide = F.lit((1 << width) - 1).cast("long")

    def key(s: int):
        left = (4 * s) % BITS
        turned = F.col("fp") if not left else F.shiftleft("fp", left).bitwiseOR(F.shiftrightunsigned("fp", BITS - left))
        return F.shiftrightunsigned(turned, BITS - width).bitwiseAND(wide).bitwiseOR(F.lit(s << width).cast("long"))

    keyed = reps.select("fp", "rep", F.posexplode(F.array(*[key(s) for s in range(SEGMENTS)])).alias("start", "key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > CELL).select("key", F.ceil(F.col("count") / CELL).cast("int").alias("chunks"))
    # cells of a hot key are pairs of chunks: each fingerprint goes to as many cells as its key has chunks
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = F.when(F.col("chunks").isNull(), F.array(F.xxhash64("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda c: F.xxhash64("key", F.least(c, own), F.greatest(c, own)))
    )
    spread = keyed.join(hot, "key", "left").select("start", "fp", "rep", F.explode(cells).alias("cell"))
    return spread.repartition("cell").sortWithinPartitions("cell", "start").mapInArrow(_linked(most), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text): component_id is the smallest doc_id reachable by links."""
    prints = cut(fingerprints(docs, shingle))
    reps = cut(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(reps, most))
    of = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles (lower case)."""
    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], "u8")
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)), "u8"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of ``WIDE`` bits (as words of 64) of a set of shingle hashes, each of which gives further words by mixing."""
    ones = np.zeros(WIDE, "i8")
    for at in range(0, len(hashes), 255):  # lanes of a byte count up to 255 rows
        h = hashes[at : at + 255, None] + _TURNS
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += _LANES[h.astype(">u8").view("u1").reshape(len(h), -1)].sum(axis=0, dtype="u8").view("u1")
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype("u8")


def ring(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, chain) of each fingerprint (rows) and start on its ring: the start with the ``EQUAL`` segments from there on, and the 64 bits that end with these."""
    chain = np.empty((len(prints), WIDE // SEGMENT), "u8")
    following = np.roll(prints, -1, axis=1)
    for turn in range(64 // SEGMENT):
        left = np.uint64(SEGMENT * turn)
        chain[:, turn :: 64 // SEGMENT] = (prints << left) | (following >> (np.uint64(64) - left)) if turn else prints
    width = np.uint64(EQUAL * SEGMENT)
    cell = (chain >> (np.uint64(64) - width)) | (np.arange(WIDE // SEGMENT, dtype="u8") << width)
    return cell, np.roll(chain, 64 // SEGMENT - EQUAL, axis=1)


def within(x: np.ndarray) -> np.ndarray:
    """Whether the differing bits x of chains of 64 bits keep the budget of every run of segments that ends the chain, read backwards from its equal ones."""
    ok = np.bitwise_count(x) <= 64 * MOST_BITS // WIDE
    for length in range(EQUAL + 1, 64 // SEGMENT):
        if SEGMENT * length * MOST_BITS // WIDE < SEGMENT * (length - EQUAL):
            ok &= np.bitwise_count(x & np.uint64((1 << SEGMENT * length) - 1)) <= SEGMENT * length * MOST_BITS // WIDE
    return ok


def begins(x: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether a run of equal segments begins with the cell's: else the pair has met in the cell of the start before. Long runs begin again every 16 starts."""
    width = EQUAL * SEGMENT
    return ((x >> np.uint64(width)) & np.uint64((1 << SEGMENT) - 1) != 0) | ((cell >> width) % (64 // SEGMENT) == 0)


def digest(text: bytes) -> bytes:
    """One for all texts of the same words."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, x, size, fp) of every row with a doc_id: the digest of its words, the number of its shingles, its wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            sizes, prints = [], []
            for t in texts:
                own = shingles(t, shingle)
                sizes.append(len(own))
                prints.append(wide_fingerprint(own))
            flat = pa.array(np.concatenate(prints).view("i8") if prints else np.empty(0, "i8"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * (WIDE // 64), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest, texts), pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "x", "size", "fp"])

    return _bytes(docs).mapInArrow(run, "doc_id long, x binary, size long, fp array<long>")


def _rings(texts: DataFrame, whole: bool = False) -> DataFrame:
    """(cell, chain, t) of texts(t, fp): a row per start on the ring; whole: with the fingerprint in each, as bytes ``fp``."""
    n = WIDE // SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):  # some 2 MB of rows at once
                part = batch.slice(at, 100)
                prints = part.column(1).flatten().to_numpy(zero_copy_only=False).view("u8").reshape(part.num_rows, -1)
                cell, chain = ring(prints)
                arrays = [pa.array(cell.ravel().view("i8")), pa.array(chain.ravel().view("i8")), pa.array(np.repeat(part.column(0).to_numpy(), n))]
                if whole:
                    ends = np.arange(n * len(prints) + 1, dtype="i4") * (WIDE // 8)
                    arrays.append(pa.Array.from_buffers(pa.binary(), n * len(prints), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.repeat(prints, n, axis=0).tobytes())]))
                yield pa.RecordBatch.from_arrays(arrays, ["cell", "chain", "t", "fp"][: len(arrays)])

    return texts.select("t", "fp").mapInArrow(run, "cell long, chain long, t long" + (", fp binary" if whole else ""))


def _cells(texts: DataFrame, front: int, whole: bool) -> DataFrame:
    """(cell, chain, t, leads) and, if whole, the fingerprint, of texts(t, fp). A hot cell is dealt as many parts, each with the cell's first ``front`` texts, which lead it.

    Hot cells are told by a sample of the texts, which only decides how the work is dealt.
    """
    rows = _rings(texts, whole)
    more = ["fp"] if whole else []
    hot = _few(_rings(texts.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0)).groupBy("cell").count().where(F.col("count") * SAMPLE >= CELL).select("cell", F.ceil(F.col("count") * SAMPLE / CELL).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows.withColumn("leads", F.lit(False))
    dealt = rows.join(hot, "cell", "left")
    part = lambda p: F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", p).bitwiseOR(F.lit(-(1 << 63))))
    own = F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")
    long_ = rows.join(hot, "cell").withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SPREAD)))
    for by in (["cell", "salt"], ["cell"]):
        long_ = long_.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("t"))).where(F.col("r") <= front)
    first = cut(long_.select("cell", "chain", "t", "parts", *more))
    leaders = first.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(part(F.col("p")).alias("cell"), "chain", "t", F.lit(True).alias("leads"), *more)
    least = first.groupBy("cell").agg(F.max("t").alias("upto"))  # what comes after the first is dealt
    rest = dealt.join(least, "cell", "left").where("upto IS NULL OR t > upto").select(part(own).alias("cell"), "chain", "t", F.lit(False).alias("leads"), *more)
    return rest.unionByName(leaders)


def _met(most: int):
    """(x, y, waits) of whole cells: y are the first texts before x in its cells whose chains (and fingerprints, where rows have them) keep their
    budgets, ``most`` at most in a task, and x waits if there are more; and, with y null, the texts that are in none of these pairs of cells that hold more for
    some x. In a dealt cell those wait that don't lead it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_ in whole_runs(batches, "cell"):
            cell, chain, t = (table_.column(c).to_numpy() for c in ("cell", "chain", "t"))
            leads = table_.column("leads").to_numpy()
            order = np.lexsort((t, ~leads, cell))
            prints = np.frombuffer(b"".join(table_.column("fp").to_pylist()), "u8").reshape(len(t), -1)[order] if "fp" in table_.column_names else None
            cell, chain, t, leads = cell[order], chain[order], t[order], leads[order]
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[start, len(cell)])
            many = np.repeat(size > 1, size)  # most cells have one text
            prints = prints if prints is None else prints[many]
            cell, chain, t, leads, size = cell[many], chain[many], t[many], leads[many], size[size > 1]
            if not len(size):
                continue
            start = np.cumsum(size) - size
            first, of = np.repeat(start, size), np.repeat(np.arange(len(size)), size)
            rank, hot = np.arange(len(t)) - first, np.repeat(leads[start], size)
            count_, over, pairs, i, f = np.zeros(len(t), "i4"), hot[start].copy(), [], np.arange(len(t)), 0
            while True:
                i = i[(rank[i] > f) & (leads[first[i] + f] | ~hot[i])]  # of a dealt cell those that lead it are compared with
                if not len(i):
                    break
                x = (chain[i] ^ chain[first[i] + f]).view("u8")
                hit = i[within(x) & (hot[i] | begins(x, cell[i]))]
                if prints is not None:
                    hit = hit[np.bitwise_count(prints[hit] ^ prints[first[hit] + f]).sum(axis=1) <= MOST_BITS]
                count_[hit] += 1
                pairs.append((t[hit], t[first[hit] + f]))
                full = hit[count_[hit] > most]
                over[of[full]] = True
                i, f = i[count_[i] <= most], f + 1
            x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
            if len(x):
                x, y = np.unique(np.stack([x, y]), axis=1)
                new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                n = np.diff(np.r_[new, len(x)])
                few = np.arange(len(x)) - np.repeat(new, n) < most
                further = np.repeat(n > most, n)
                x, y, further = x[few], y[few], further[few]
                for at in range(0, len(x), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x[part]), pa.array(y[part]), pa.array(further[part])], ["x", "y", "waits"])
            waits, rest = np.unique(t[hot & ~leads]), np.unique(t[np.repeat(over, size)])
            for own, flag in ((waits, True), (np.setdiff1d(rest, np.concatenate([waits, x, y])), False)):  # those in pairs are known from these
                for at in range(0, len(own), 100_000):
                    part = own[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.int64()), pa.array(np.full(len(part), flag))], ["x", "y", "waits"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """Cut, in as many files as there are cores: rows of pairs and ids, small beside the texts."""
    return cut(df.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism)))


def _salted(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left(x, ...) joined with the smaller right on a column of which left may have one hot value."""
    every = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt")
    return left.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SPREAD)).cast("int")).join(right.select("*", every), [on, "salt"], how).drop("salt")


def _alike(pairs: DataFrame, texts: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(x, y) of the pairs that pass the full Hamming check and whose shingles, counted over whole texts, are as similar as asked."""
    named = pairs.select(F.col("y").alias("t")).distinct()
    of_y = texts.join(named, "t", "left_semi").select(F.col("t").alias("y"), F.col("fp").alias("fp_y"), F.col("size").alias("size_y"))
    both = _salted(pairs.join(texts.select(F.col("t").alias("x"), "fp", "size"), "x"), of_y, "y")
    bits = F.aggregate(F.zip_with("fp", "fp_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    # the Jaccard similarity is at most the smaller size over the larger one
    close = _few(both.where(F.least("size", "size_y") >= similarity * F.greatest("size", "size_y")).where(bits <= MOST_BITS).select("x", "y"))
    wanted = close.select(F.col("x").alias("t")).unionByName(close.select(F.col("y").alias("t"))).distinct()
    wanted = texts.join(wanted, "t", "left_semi").select("t", F.col("m").alias("doc_id"), F.col("x").alias("d"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a repeated doc_id may have further texts
            keep = [digest(x.as_py() or b"") == d for x, d in zip(batch.column(2), batch.column(1).to_pylist(), strict=True)]
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    found = cut(_bytes(docs).join(wanted, "doc_id").select("t", "d", "text").mapInArrow(own, "t long, text binary").dropDuplicates(["t"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, "u8")
        for batch in batches:
            keep = []
            for y, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if y != last:
                    last, held = y, shingles(b.as_py() or b"", shingle)
                keep.append(jaccard(shingles(a.as_py() or b"", shingle), held) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of_y = found.join(close.select(F.col("y").alias("t")).distinct(), "t", "left_semi").select(F.col("t").alias("y"), F.col("text").alias("text_y"))
    rows = _salted(close.join(found.withColumnRenamed("t", "x"), "x"), of_y, "y").select("x", "y", "text", "text_y")
    return cut(rows.sortWithinPartitions("y").mapInArrow(run, "x long, y long"))


def _settled(alike: DataFrame, waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alike without the pairs of texts that go, (t) of those): a text stays once it doesn't wait and no smaller one that may stay is alike it."""
    gone = None
    while True:
        stay = alike.select("y").distinct().join(alike.select(F.col("x").alias("y")), "y", "left_anti").join(waiting.select(F.col("t").alias("y")), "y", "left_anti")
        go = _few(_salted(alike, stay, "y").select(F.col("x").alias("t")).distinct())
        gone = go if gone is None else gone.unionByName(go)
        if go.isEmpty():
            return alike, gone
        left = alike.join(go.withColumnRenamed("t", "x"), "x", "left_anti")
        alike = _few(_salted(left, go.withColumnRenamed("t", "y"), "y", "left_anti").select("x", "y"))


def gone_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id) of the documents that go: all their texts are alike one of a smaller document that stays; no two found alike both stay.

    Texts of equal words are one. The others have ``WIDE``-bit SimHash fingerprints on a ring of segments. Two texts meet in the cell
    of a start from which ``EQUAL`` segments are equal; the chain from there must keep its budgets, at ``MOST_BITS`` on the whole ring, then
    all bits are compared, then all shingles. In a round each text is compared with the first texts that it meets, and what is alike
    a text that stays is taken out; texts that meet more go on, with more at a time. So a group of m copies costs about m
    comparisons, not m * m.
    """
    spark = docs.sparkSession
    sketched = cut(sketches(docs, shingle))
    # numbered in the order of (smallest doc_id, digest)
    texts = sketched.groupBy("x").agg(F.min("doc_id").alias("m"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp")).orderBy("m", "x")
    texts = cut(texts.withColumn("t", F.monotonically_increasing_id()))
    gone, alike, tested = spark.createDataFrame([], "t long"), spark.createDataFrame([], "x long, y long"), spark.createDataFrame([], "x long, y long")
    left, most = texts.where(F.col("size") > 0), FRONT
    while True:
        # the first round is of all texts; the few of the others bring their fingerprints along
        met = cut(_cells(left, 64 * most, most > FRONT).repartition("cell").sortWithinPartitions("cell").mapInArrow(_met(most), "x long, y long, waits boolean"))
        firsts = F.row_number().over(Window.partitionBy("x").orderBy("y"))
        near = _few(met.where("y IS NOT NULL").groupBy("x", "y").agg(F.max("waits").alias("waits")).withColumn("r", firsts).where(F.col("r") <= most + 1))
        pairs = _few(near.where(F.col("r") <= most).select("x", "y").join(tested, ["x", "y"], "left_anti"))
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            alike = _few(alike.unionByName(_alike(pairs, texts, docs, shingle, similarity)))
        waiting = _few(near.where((F.col("r") > most) | F.col("waits")).select(F.col("x").alias("t")).unionByName(met.where("y IS NULL AND waits").select(F.col("x").alias("t"))).distinct())
        alike, went = _settled(alike, waiting)
        gone = _few(gone.unionByName(went))
        waiting = _few(waiting.join(gone, "t", "left_anti"))
        if waiting.isEmpty():
            break
        held = met.select(F.col("x").alias("t")).unionByName(met.where("y IS NOT NULL").select(F.col("y").alias("t"))).distinct()
        left = cut(left.join(held.join(gone, "t", "left_anti"), "t", "left_semi"))
        most *= 4
    lost = texts.join(gone.withColumn("gone", F.lit(True)), "t", "left").select("x", "m", F.coalesce("gone", F.lit(False)).alias("gone"))
    # the largest digest group may hold a third of all rows, so its rows are dealt
    of = _salted(sketched.select(F.col("x").alias("d"), "doc_id", F.xxhash64("doc_id").alias("x")), lost.withColumnRenamed("x", "d"), "d")
    return of.groupBy("doc_id").agg(F.min(F.col("gone") | (F.col("doc_id") != F.col("m"))).alias("goes")).where("goes").select("doc_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay when near copies go, the smallest doc_id first.

    A document goes if it shares at least ``similarity`` of its distinct word shingles (Jaccard over whole texts) with a
    document of a smaller doc_id that stays (see ``gone_documents``). Rows without doc_id stay. Repeated doc_ids are one
    document: all its rows stay, if any of its texts is to stay, or all go.
    """
    name = next(n for k in count() if (n := f"gone_{k}") not in {c.lower() for c in docs.columns})
    gone = _few(gone_documents(docs, shingle, similarity)).withColumnRenamed("doc_id", name)
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLES: dict[str, str] = {}
