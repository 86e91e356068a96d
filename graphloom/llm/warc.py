"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing. Each task streams its records, one gzip member each, to archives in a shared folder (any that pyarrow.fs opens: local
or NFS, HDFS, object stores) and returns an index row per record: file, offset, length, URL, payload digest, kind. The index
is a Parquet table; its commit makes the archives of the successful task attempts count, and what lost or repeated attempts
have left is never read. Of records with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a
response and the others are revisits that refer to it; smaller ones are all responses.

Reading. Selected index rows are dealt by file and range, sorted by offset, and neighbours at most ``GAP`` bytes apart are
read at once, up to ``SPAN`` bytes. A revisit keeps the HTTP header of its page, and so the full payload's length and digest.

Nulls and odd input: a null html is an empty payload; a null url leaves out the target URI; a null page_id never is a
group's first while another page_id is there, and refers to that; repeated page_ids keep a record each, and those with the
first's page_id are responses like it; an empty table gives an empty index; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, table

#: Bytes of an archive after which the next is begun; of a gap that is read over; of one read at most.
ROLL, GAP, SPAN = 256 << 20, 64 << 10, 8 << 20
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, intact boolean"


def base32(hex_digest: Column) -> Column:
    """The bare upper-case base32 of a SHA-1 in hex: 20 bits, that is 5 hex and 4 base32 digits, at a time."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The parts of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http + b"\r\n")[1])
    number = lambda x: int(m[1]) if x and (m := re.search(r"urn:page:(-?\d+)", x)) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    intact = kind == "revisit" or len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload_digest": digest, "payload_bytes": size, "payload": payload if kind != "revisit" else None, "intact": intact}


def kinds(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with payload, payload_digest, record_type and refers_to."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("payload_digest", base32(F.sha1("payload")))
    shared = base.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    joined = base.join(cut(shared), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least)
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the archives below ``folder`` and their index to ``folder``/index; returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(f"{path}/archives", recursive=True)
        # no two attempts share a name, and only the attempt whose index rows are committed is ever read
        stem = f"{path}/archives/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        stream, name, at, number = None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for r in range(batch.num_rows):
                    page_id, url, payload, digest, kind, refers_to = (c[r].as_py() for c in batch.columns)
                    if stream is None or at >= ROLL:
                        if stream:
                            stream.close()
                        name, at, number = f"{stem}-{number}.warc.gz", 0, number + 1
                        stream = store.open_output_stream(name, compression=None)
                    member = gzip.compress(record(page_id, url, payload, digest, kind, refers_to), 5, mtime=0)
                    stream.write(member)
                    rows.append((page_id, url, digest, kind, refers_to, name.removeprefix(f"{path}/"), at, len(member)))
                    at += len(member)
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], [f.split(" ")[0] for f in INDEX.split(", ")])
        finally:
            if stream:
                stream.close()

    spark = pages.sparkSession
    kinds(pages, least).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, numbers) of the reads that cover sorted (offset, length) ranges."""
    out: list[list] = []
    for k, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][1] <= GAP and offset + length - out[-1][0] <= SPAN:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2].append(k)
        else:
            out.append([offset, offset + length, [k]])
    return [tuple(x) for x in out]


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows, in RECORD's columns (payload null if not asked for); ``intact`` says if a response's payload has its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            first = 0
            while first < len(files):
                last = first
                while last < len(files) and files[last] == files[first]:
                    last += 1
                with store.open_input_file(f"{path}/{files[first]}") as f:
                    for start, end, numbers in coalesced(list(zip(offsets[first:last], lengths[first:last], strict=True))):
                        raw = f.read_at(end - start, start)
                        found = []
                        for k in numbers:
                            at = offsets[first + k] - start
                            x = parse(gzip.decompress(raw[at : at + lengths[first + k]]))
                            found.append([x[n] if n != "payload" or payloads else None for n in names])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
                first = last

    # index rows are small beside what they stand for, so the number of tasks follows the bytes to read
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // SPAN))
    at = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN).alias("part")).repartition(tasks, "file", "part").sortWithinPartitions("file", "offset")
    return at.select("file", "offset", "length").mapInArrow(run, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), folder)
    found = read(index, folder, payloads=False)
    sound = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload read back has another digest")))
    return found.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g[{i}] >> {s}) & 31), 1)" for i in range(1, 9) for s in (15, 10, 5, 0)
)
OP5_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(1 + 5 * i AS BIGINT), 5) AS INTEGER)) AS g FROM p),
d AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM g),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": OP5_SQL}
