"""Repeated-substring dedup over merged Burrows-Wheeler transforms.

What goes: each byte covered by a ``width``-byte string that also starts in a document with a smaller doc_id. Matches never cross
documents, overlaps count, and strings are judged on the input.

1. Every ``width``-byte window has a minimizer, the smallest hash of its ``GRAM``-byte parts, so equal windows have equal
   minimizers. Minimizers that only one document has cannot be repeated; tasks exchange the hashes alone to find the others. What two
   documents of one task share is known to be repeated at once, and only its smallest document is exchanged.
2. The texts of the others are cut into runs of windows with one minimizer, and runs are dealt to buckets by it: all copies of a
   window meet in one bucket, and only text that may be repeated moves. Of equal runs in one task only those of the smallest document move:
   the others are repeated for certain. Runs of minimizers that a sample shows to be frequent are cut and dealt by a second minimizer too.
3. A bucket's distinct runs form a collection of strings, in shards of bounded size. Each shard is suffix-sorted by itself and gives its
   Burrows-Wheeler transform. The merged order of all shards comes from interleave refinement: starting from the
   shards one after another, each round stably deals the rows by the symbol before them, which orders them by one symbol more
   without comparing suffixes again; which row of its shard comes next follows from counting symbols in the transform, as rows are in the order of
   their suffixes. A boundary that appears in round l marks a common prefix of l - 1 symbols; after ``width``
   rounds the blocks without boundary are the repeated intervals. A row whose block has no other row has a unique prefix, as has
   whatever extends it to the left, and leaves the refinement.
4. Each interval's smallest doc_id goes to all its windows, and each occurrence keeps the windows whose smallest doc_id is below its own.
5. The windows of a document are united and cut from its text.

Scale. No step sees the whole corpus; buckets grow in number with the input, texts move compressed, distinct runs are sorted once
whatever their copies. A run that all documents have costs its bucket one row for every ``FLUSH`` bytes of text, and what differs around it is
dealt apart by the second minimizer.

Nulls and odd input: a null text counts as empty; texts shorter than a window keep all bytes; rows without doc_id lose nothing and
take nothing from others; of rows with one doc_id none is smaller, so they don't shorten each other (repeated rows give equal
results); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH, GRAM = 50, 20
#: Bytes of text that a bucket stands for; of runs that a task gathers before it sends them; symbols of a shard; end of a string (no byte of UTF-8).
BUCKET, FLUSH, SHARD, END = 4 << 20, 32 << 20, 1 << 20, 0xFF
#: One document in so many tells frequent minimizers: those that ``HOT`` of these have, the ``MOST_HOT`` most frequent ones (8 bytes each in a broadcast).
#: They only decide how runs are dealt.
SAMPLE, HOT, MOST_HOT = 64, 512, 1_000_000
#: Most minimizers that a row names, so that rows are of one size whatever the number of tasks.
PER_ROW = 4
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def minimizers(text: bytes, width: int = WIDTH, turn: int = 0) -> np.ndarray:
    """The smallest hash of the GRAM-byte parts of each window, by window; turn 1: by another hash."""
    grams, windows = len(text) - GRAM + 1, len(text) - width + 1
    if windows <= 0:
        return np.empty(0, "u8")
    words = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
    x = words[:grams] * _A
    x ^= x >> np.uint64(29)
    x += words[8 : grams + 8]
    x *= _B
    x ^= x >> np.uint64(32)
    x += words[GRAM - 8 : GRAM - 8 + grams]
    x *= _C
    x ^= x >> np.uint64(31)
    if turn:
        x *= _B
        x ^= x >> np.uint64(30)
    span, size = width - GRAM + 1, 1
    while 2 * size <= span:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:windows], x[span - size : span - size + windows]) if size < span else x[:windows]


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(arrays), *(a.nbytes for a in arrays)], "i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "i8", 1)[0])
    sizes = np.frombuffer(raw, "i8", n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [np.frombuffer(raw, k, s // np.dtype(k).itemsize, e - s) for k, s, e in zip(kinds, sizes.tolist(), ends.tolist(), strict=True)]


def _blobs(bucket: np.ndarray, arrays: list[np.ndarray], texts: list[bytes] | None = None) -> Iterator[tuple[int, bytes]]:
    """The rows of each bucket, packed."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else np.zeros(1, int)
    for a, b in zip(edges, edges[1:]):
        own = order[a:b]
        more = [np.frombuffer(b"".join([texts[k] for k in own.tolist()]), "u1")] if texts is not None else []
        yield int(bucket[own[0]]), _packed(*(x[own] for x in arrays), *more)


def _send(found, names) -> Iterator[pa.RecordBatch]:
    keys, data = [], []
    for k, d in found:
        keys.append(k)
        data.append(d)
        if len(keys) >= 64:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names)
            keys, data = [], []
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names)


def _parted(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and place in it of each minimizer. Buckets are as many as the text asks for, so 32 bits tell nearly all in one apart;
    those that agree are only looked at together."""
    return (h % np.uint64(buckets)).astype("i4"), (h // np.uint64(buckets)).astype("u4")


def _beside(number: int, buckets: int) -> int:
    """A negative bucket, for what is known already and only passes through the exchange; spread over tasks and flushes."""
    task = TaskContext.get()
    return -1 - ((task.partitionId() if task else 0) * 7919 + number) % buckets


def _among(h: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Whether each of h is in the sorted array."""
    if not len(sorted_):
        return np.zeros(len(h), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h


def _frequent(base: DataFrame, width: int) -> np.ndarray:
    """The sorted minimizers that many documents have, by a sample of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(minimizers(text.as_buffer().to_pybytes(), width)).view("i8"))], ["h"])

    own = base.where(F.octet_length("text") >= width).where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = own.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= HOT)
    return np.sort(np.array([r.h for r in counts.orderBy(F.desc("count"), "h").limit(MOST_HOT).collect()], "i8").view("u8"))


def _hashes(width: int, buckets: int, frequent):
    """(bucket, data) of (doc_id, text): the distinct minimizers of each document that this task doesn't find repeated, and, in negative buckets, those that it does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, rows, number = [], [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.unique(minimizers(text.as_buffer().to_pybytes(), width)) if text.is_valid and len(text.as_buffer() or b"") >= width else ()
                if len(h):
                    held.append(h)
                    docs.append(doc)
                    rows += len(h)
                if rows * 16 > FLUSH:
                    yield from _flush(held, docs, number)
                    held, docs, rows, number = [], [], 0, number + 1
        if held:
            yield from _flush(held, docs, number)

    def _flush(held, docs, number):
        h, doc = np.concatenate(held), np.repeat(np.array(docs, "i8"), [len(x) for x in held])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.r_[True, h[1:] != h[:-1]]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(h)] - 1
        hot = _among(h[first], frequent.value)
        shared = (doc[first] != doc[last]) | hot
        send = ~np.repeat(shared, last - first + 1) | (new & np.repeat(shared & ~hot, last - first + 1))
        bucket, rest = _parted(h, buckets)
        many = np.repeat(shared, last - first + 1)
        yield from _send(_blobs(bucket[send], [rest[send], doc[send], many[send].astype("u1")]), ["bucket", "data"])
        if many.any():
            bucket, rest, doc = bucket[many], rest[many], doc[many]
            order = np.argsort(doc, kind="stable")
            yield from _send([(_beside(number, buckets), _packed(doc[order], bucket[order].astype("u4"), rest[order]))], ["bucket", "data"])

    return run


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The packed rows of each bucket; the input is sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for k, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(d.as_buffer().to_pybytes())
    if held:
        yield now, held


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, data): the minimizers of each document that another document has too, from one bucket. data: pairs of bucket and rest."""

    def out(docs, held):
        doc, pairs = np.concatenate(docs), np.concatenate(held)
        order = np.argsort(doc, kind="stable")
        doc, pairs = doc[order], pairs[order]
        new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        place = np.arange(len(doc)) - np.repeat(new, np.diff(np.r_[new, len(doc)]))
        edges = np.r_[np.flatnonzero(place % PER_ROW == 0), len(doc)]
        for at in range(0, len(edges) - 1, 5000):
            own = edges[at : at + 5001]
            yield pa.RecordBatch.from_arrays([pa.array(doc[own[:-1]]), pa.array([pairs[a:b].tobytes() for a, b in zip(own, own[1:])], pa.binary())], ["doc_id", "data"])

    docs, held, total = [], [], 0  # of all buckets of the task, so that a document gets few rows
    for bucket, rows in _bucket_rows(batches):
        if bucket < 0:
            for row in rows:
                doc, of, rest = _unpacked(row, "i8", "u4", "u4")
                docs.append(doc)
                held.append(np.stack([of, rest], axis=1))
                total += len(doc)
        else:
            parts = [_unpacked(r, "u4", "i8", "u1") for r in rows]
            h, doc, known = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((doc, h))
            h, doc, known = h[order], doc[order], known[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            last = np.r_[first[1:], len(h)] - 1
            many = np.repeat((doc[first] != doc[last]) | (np.maximum.reduceat(known, first) > 0), last - first + 1) & (known == 0)
            docs.append(doc[many])
            held.append(np.stack([np.full(int(many.sum()), bucket, "u4"), h[many]], axis=1))
            total += len(held[-1])
        if total * 16 > FLUSH // 2:
            yield from out(docs, held)
            docs, held, total = [], [], 0
    if total:
        yield from out(docs, held)


def _runs(width: int, buckets: int, frequent):
    """(bucket, data) of (doc_id, copy, z, found): the runs of windows whose minimizer is among the found ones, and, in negative buckets, (doc_id, copy, first, last)
    of the windows of runs that a smaller document of this task has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, size, number = [], [], 0, 0
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, copy, z, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                text = unzip.decompress(z.as_buffer().to_pybytes())
                pairs = np.concatenate([np.frombuffer(x.as_buffer(), "u4") for x in found.values]).astype("u8").reshape(-1, 2)
                known = np.sort((pairs[:, 0] << np.uint64(32)) | pairs[:, 1])
                h = minimizers(text, width)
                edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]) if len(h) else np.zeros(1, int)
                bucket, rest = _parted(h[edges[:-1]], buckets)
                use = _among((bucket.astype("u8") << np.uint64(32)) | rest, known)
                hot = use & _among(h[edges[:-1]], frequent.value)
                if hot.any():
                    length = np.diff(edges)
                    turned = np.where(np.repeat(hot, length), (h ^ minimizers(text, width, 1)) * _A, h)
                    new = np.r_[True, turned[1:] != turned[:-1]]
                    new[edges[:-1]] = True
                    use = np.repeat(use, length)[new]
                    edges = np.r_[np.flatnonzero(new), len(h)]
                    bucket, rest = _parted(turned[edges[:-1]], buckets)
                use = np.flatnonzero(use)
                first, last = edges[:-1][use], edges[1:][use]
                texts += [text[a : b + width - 1] for a, b in zip(first.tolist(), last.tolist())]
                rows.append((bucket[use], rest[use], np.full(len(use), doc), np.full(len(use), copy), first, last - first + width - 1))
                size += int((last - first).sum()) + 90 * len(use)
                if size > FLUSH:
                    yield from _flush(rows, texts, number)
                    rows, texts, size, number = [], [], 0, number + 1
        if rows:
            yield from _flush(rows, texts, number)

    def _flush(rows, texts, number):
        bucket, rest, doc, copy, first, size = (np.concatenate(x) for x in zip(*rows, strict=True))
        doc, copy, first, size = doc.astype("i8"), copy.astype("i8"), first.astype("u4"), size.astype("u4")
        of: dict[bytes, int] = {}
        own = np.fromiter((of.setdefault(x, len(of)) for x in texts), "i8", len(texts))
        smallest = np.full(len(of), np.iinfo("i8").max)
        np.minimum.at(smallest, own, doc)
        sent = doc == smallest[own]
        if not sent.all():
            yield from _send([(_beside(number, buckets), _packed(doc[~sent], copy[~sent], first[~sent], size[~sent]))], ["bucket", "data"])
        texts = [texts[k] for k in np.flatnonzero(sent).tolist()]
        yield from _send(_blobs(bucket[sent], [rest[sent], doc[sent], copy[sent], first[sent], size[sent]], texts), ["bucket", "data"])

    return run


class Shard:
    """Strings, each closed by END: their suffixes in order (ends by place), and the Burrows-Wheeler transform, the symbol before each."""

    def __init__(self, text: np.ndarray, at_once: int = 8):
        """at_once: the symbols that the first of the sorts compares, 8 at most; each further one doubles them until all suffixes differ."""
        n = len(text)
        padded = np.concatenate([text, np.full(at_once, END, "u1")])
        key = np.zeros(n, "u8")
        open_ = np.ones(n, bool)  # whether no string has ended yet
        for k in range(at_once):
            symbol = padded[k : k + n]
            key = (key << np.uint64(8)) | np.where(open_, symbol, 0).astype("u8")
            open_ &= symbol != END
        self.order = np.argsort(key).astype("i4")
        ended = np.flatnonzero(~open_[self.order])  # suffixes that have ended are alone; equal ones come by place
        own = self.order[ended]
        self.order[ended] = own[np.lexsort((own, key[own]))]
        sorted_ = key[self.order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]] | ~open_[self.order]
        first = np.flatnonzero(new)
        rank = np.empty(n, "i4")  # the place of the first suffix that is equal so far
        rank[self.order] = np.repeat(first, np.diff(np.r_[first, n]))
        many = np.repeat(np.diff(np.r_[first, n]) > 1, np.diff(np.r_[first, n]))
        size, left = at_once, self.order[many]
        del key, sorted_, new, first, many, open_, own, ended
        while len(left):
            # doubling: the rank of what follows orders those that are still together, in their own places
            key = (rank[left].astype("u8") << np.uint64(32)) | rank[left + size].astype("u8")
            by = np.argsort(key)
            left, key = left[by], key[by]
            old = (key >> np.uint64(32)).astype("i8")
            start_old = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            in_old = np.arange(len(left)) - np.repeat(start_old, np.diff(np.r_[start_old, len(left)]))
            self.order[old + in_old] = left
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[start, len(left)])
            rank[left] = np.repeat((old + in_old)[start], length)
            left, size = left[np.repeat(length > 1, length)], 2 * size
        self.before = text[self.order - 1]  # of the first suffix: the last END

    def lf(self) -> np.ndarray:
        """The row of the suffix one symbol longer: the transform's k-th c is the k-th row that starts with c, as rows are in the order of their suffixes."""
        place = np.empty(len(self.before), "i4")
        place[np.argsort(self.before, kind="stable")] = np.arange(len(place), dtype="i4")
        return place


def intervals(shards: list[Shard], width: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, block): from the shards' transforms, the rows (numbered through all shards) that share their first ``width`` symbols with another row, by block.

    ends: whether a row is ``width`` or more symbols inside its string, where a window can end. A window's row comes from the row of its
    end, one symbol further left each round, so the rounds need no other rows.
    """
    offsets = np.cumsum([0, *(len(s.before) for s in shards)])
    before = np.concatenate([s.before for s in shards])
    lf = np.concatenate([s.lf() + np.int32(o) for s, o in zip(shards, offsets)])
    rows = np.arange(offsets[-1], dtype="i4")  # the interleave: the shards one after another
    rows = rows if ends is None else rows[ends]
    block = np.zeros(len(rows), "i4")
    for _ in range(width):
        symbol = before[rows]
        order = np.argsort(symbol, kind="stable")
        order = order[: np.searchsorted(symbol[order], END)]  # string starts go no further
        symbol, old, rows = symbol[order], block[order], lf[rows[order]]
        if not len(rows):
            break
        new = np.r_[True, (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])]  # where the common prefix ends
        keep = ~(new & np.r_[new[1:], True])  # a block of one row is a prefix that nothing shares
        block, rows = np.cumsum(new, dtype="i4")[keep], rows[keep]
    return rows, block


def _judged(width: int):
    """(doc_id, copy, first, last) of windows that also start in a document with a smaller doc_id, from whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, packed in _bucket_rows(batches):
            if bucket < 0:
                for row in packed:
                    doc, copy, first, size = _unpacked(row, "i8", "i8", "u4", "u4")
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(copy), pa.array(first.astype("i4")), pa.array((first + size - width).astype("i4"))], ["doc_id", "copy", "first", "last"])
                continue
            number: dict[bytes, int] = {}
            strings, cols = [], []
            for data in packed:
                rest, doc, copy, first, size, text = _unpacked(data, "u4", "i8", "i8", "u4", "u4", "u1")
                raw, ends = text.tobytes(), np.cumsum(size, dtype="i8").tolist()
                own = np.empty(len(ends), "i8")
                at = 0
                for k, end in enumerate(ends):
                    s = raw[at:end]
                    i = number.setdefault(s, len(strings))
                    if i == len(strings):
                        strings.append(s)
                    own[k], at = i, end
                cols.append((own, doc, copy, first.astype("i8"), rest))
            del packed
            own, doc, copy, first, rest = (np.concatenate(x) for x in zip(*cols, strict=True))
            smallest = np.full(len(strings), np.iinfo("i8").max)
            np.minimum.at(smallest, own, doc)
            size = np.fromiter(map(len, strings), "i8", len(strings))
            windows = size - width + 1
            base = np.cumsum(windows) - windows
            least = np.repeat(smallest, windows)
            # runs of one minimizer stay together, so that most of what is equal is in one shard
            group = np.zeros(len(strings), "u4")
            group[own] = rest
            order = np.argsort(group, kind="stable")
            shards, number_of, offset_of, held, total = [], [], [], [], 0
            for k, i in enumerate(order.tolist()):
                held.append(i)
                total += len(strings[i]) + 1
                if total >= SHARD or k + 1 == len(order):
                    text = np.frombuffer(b"".join([strings[i] + b"\xff" for i in held]), "u1")
                    shards.append(Shard(text))
                    n = np.array([len(strings[i]) + 1 for i in held])
                    number_of.append(np.repeat(np.array(held, "i4"), n)[shards[-1].order])
                    offset_of.append((np.arange(len(text), dtype="i4") - np.repeat((np.cumsum(n) - n).astype("i4"), n))[shards[-1].order])
                    shards[-1].order = None  # the transform carries the merge
                    held, total = [], 0
            rows, block = intervals(shards, width, np.concatenate(offset_of) >= width)
            if len(rows):
                at = (base[np.concatenate(number_of)[rows]] + np.concatenate(offset_of)[rows])
                start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                lowest = np.minimum.reduceat(least[at], start)
                least[at] = np.repeat(lowest, np.diff(np.r_[start, len(block)]))
            del shards, number_of, offset_of
            low, high = np.minimum.reduceat(least, base), np.maximum.reduceat(least, base)
            whole = doc > high[own]
            if whole.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[whole]), pa.array(copy[whole]), pa.array(first[whole], pa.int32()), pa.array(first[whole] + windows[own[whole]] - 1, pa.int32())], ["doc_id", "copy", "first", "last"])
            some = np.flatnonzero((doc > low[own]) & ~whole)
            for a in range(0, len(some), 20_000):
                part = some[a : a + 20_000]
                t = own[part]
                n = windows[t]
                row = np.repeat(np.arange(len(t)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                hit = np.flatnonzero(doc[part][row] > least[base[t][row] + place])
                new = np.r_[True, (row[hit][1:] != row[hit][:-1]) | (hit[1:] != hit[:-1] + 1)]
                lo, hi = hit[new], hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1]]
                r = part[row[lo]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(copy[r]), pa.array(first[r] + place[lo], pa.int32()), pa.array(first[r] + place[hi], pa.int32())], ["doc_id", "copy", "first", "last"])

    return run


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, text) with the text compressed."""
    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = [zip_.compress(x.as_buffer().to_pybytes() if x.is_valid and x.as_buffer() else b"") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["doc_id", "copy", "z"])


def spans(docs: DataFrame, width: int = WIDTH, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, found): texts(doc_id, copy, z) of all rows, z compressed, and found(doc_id, spans) with the runs of repeated windows (copy, first, last) of those that have any."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(32, -(-total // BUCKET))
    # unlike texts with one doc_id are told apart by their hash; texts move once, compressed, for both joins
    texts = base.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    zipped = texts.mapInArrow(_zipped, "doc_id long, copy long, z binary")
    named = zipped.where("doc_id IS NOT NULL")  # alike in both joins, so that one exchange serves both
    usable = base.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(usable, width))
    bucketed = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    hashes = bucketed(usable.mapInArrow(_hashes(width, buckets, frequent), "bucket int, data binary"))
    repeated = hashes.mapInArrow(_repeated, "doc_id long, data binary").groupBy("doc_id").agg(F.collect_list("data").alias("found"))
    flagged = named.join(repeated, "doc_id").select("doc_id", "copy", "z", "found")
    runs = bucketed(flagged.mapInArrow(_runs(width, buckets, frequent), "bucket int, data binary"))
    found = runs.mapInArrow(_judged(width), "doc_id long, copy long, first int, last int")
    return zipped, found.groupBy("doc_id").agg(F.collect_list(F.struct("copy", "first", "last")).alias("spans"))


def cut_out(text: bytes, windows: list, width: int) -> tuple[bytes, int, int]:
    """(kept, bytes removed, maximal runs removed)."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for first, last in sorted(windows):
        if first > end:  # not even adjacent to the run before
            kept.append(text[at:first])
            runs += 1
            removed += last + width - first
        elif last + width > end:
            removed += last + width - end
        end = max(end, last + width)
        at = end
    return b"".join([*kept, text[at:]]), removed, runs


def repeats(docs: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept is null where nothing was removed."""
    zipped, found = spans(docs, width, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for copy, z, own in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                raw = unzip.decompress(z.as_buffer().to_pybytes())
                windows = [(s["first"], s["last"]) for s in own.as_py() if s["copy"] == copy] if own.is_valid else []
                kept, removed, runs = cut_out(raw, windows, width)
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept if removed else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = zipped.where("doc_id IS NOT NULL").join(found, "doc_id", "left").select("doc_id", "copy", "z", "spans")
    joined = joined.unionByName(zipped.where("doc_id IS NULL").withColumn("spans", F.lit(None).cast(joined.schema["spans"].dataType)))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op7_bwt_dedup": op7_bwt_dedup}
ORACLES: dict[str, str] = {}
