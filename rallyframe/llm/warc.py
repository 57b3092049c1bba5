"""Deterministic sharded WARC files of pages, and their reader.

Pages are sorted by ranges of page_id, called shards, whose bounds come from exact sums of bytes over the ids in order: they depend on the data alone,
not on a sample, on partitions or on adaptive plans. Each shard is written as gzip members, one a
record, and rolls to a new file when the compressed size passes a bound. Headers and digests are made anew
from the payload, so equal tables give equal files. A file is written under a temporary
name of the attempt and renamed when complete; the manifest, written by Spark at the end,
names the files that count. A lost executor's shards are written again under the same final names.

Of equal payloads of MIN_REVISIT bytes or more the row with the largest page_id becomes a response
and the others revisit it; rows that repeat both page_id and payload are all responses if theirs is the largest page_id.
Nulls: a null html is an empty payload; a null url becomes a urn; a null page_id is kept as null
and never elected while there is another. An empty table gives an empty manifest.

Plan: pages move once (to their shards; sizes by id are summed first, without payloads). Which page is the response is decided on digests, pre-aggregated
in each task; revisits reach the writer as short rows in the same shards, so that
no join moves payloads and a payload with very many copies is no hot key.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from .shared import columns, new_path, to_arrow, whole_text

MIN_REVISIT = 1000
ROLL_BYTES = 64 << 20
#: Bytes of payloads and headers of a shard, or more where there would be over SHARDS of them.
SHARD_BYTES, SHARDS, HEAD_BYTES = 16 << 20, 65_536, 600
READERS = 20_000  # tasks that read, at most; each takes all files that fall to it
DATE = "2000-01-01T00:00:00Z"  # a fixed value: no clock in deterministic files
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = columns(file="str", n_records="long", n_bytes="long", sha256="str")
RECORDS = columns(page_id="long", payload_bytes="long", payload_digest="str", record_type="str", refers_to="long", url="str", payload="bytes")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(raw: bytes) -> dict:
    """A record's fields; raises if a digest does not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ValueError("a block does not fit its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload does not fit its digest")
    number = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "url": fields["WARC-Target-URI"], "payload": None if revisit else payload,
    }


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    data, unpack, parts = b"", zlib.decompressobj(31), []
    while data or (data := stream.read(chunk)):
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


class _Files:
    """Files of one task: temporary names, renamed when complete."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.store, self.folder = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.n, self.out = shard, roll, 0, None
        self.attempt = uuid.uuid4().hex
        self.store.create_dir(self.folder, recursive=True)

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.out = self.store.open_output_stream(f"{self.folder}/.{self.name}.{self.attempt}.tmp", compression=None)
            self.records, self.size, self.hash = 0, 0, hashlib.sha256()
        self.out.write(data)
        self.hash.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.store.move(f"{self.folder}/.{self.name}.{self.attempt}.tmp", f"{self.folder}/{self.name}")
        self.out, self.n = None, self.n + 1
        return self.name, self.records, self.size, self.hash.hexdigest()


def shards(rows: DataFrame) -> tuple[Column, int]:
    """The shard of a page_id (0 for null), and how many there are: bounds are ids at which exact running sums of bytes pass multiples of one size."""
    sizes = rows.filter("page_id is not null").groupBy("page_id").agg(F.sum(F.octet_length("html") + HEAD_BYTES).alias("bytes"))
    placed = running_totals(sizes, ["page_id"], {"before": F.col("bytes")})
    total = placed.agg(F.max(F.col("before") + F.col("bytes"))).first()[0] or 0
    size = max(SHARD_BYTES, -(-total // SHARDS))
    bounds = placed.groupBy(F.floor(F.col("before") / F.lit(size)).alias("s")).agg(F.min("page_id").alias("low")).select("low")
    lows = np.sort(np.array([r["low"] for r in bounds.collect()], np.int64))  # SHARDS + 1 numbers at most

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(lows, ids, "right"), dtype="int32")

    return F.when(F.col("page_id").isNull(), 0).otherwise(shard(F.coalesce("page_id", F.lit(0)))), len(lows) + 1


def write_warc(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) under path; returns the manifest."""
    html = whole_text("html")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.select("page_id", "digest").filter(F.octet_length("html") >= MIN_REVISIT)
    elected = large.groupBy("digest").agg(F.max("page_id").alias("elected"), F.count("*").alias("n")).filter("n > 1").select("digest", "elected")
    revisits = large.join(elected, "digest").filter(~F.col("page_id").eqNullSafe(F.col("elected"))).distinct()
    both = rows.select("page_id", F.lit(1).alias("kind"), "digest", F.lit(None).cast("long").alias("elected"), "url", "html").unionByName(
        revisits.select("page_id", F.lit(0).alias("kind"), "digest", "elected", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    )
    order = F.col("page_id").asc_nulls_first()
    schema = to_arrow(MANIFEST)

    def manifest(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, shard, page, known = None, None, object(), {}
        for batch in batches:
            done: list[tuple] = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if files is not None and files.out is not None:
                        done.append(files.close())
                    shard, page = row["shard"], object()
                    files = _Files(f"{path}/records", shard, roll_bytes)
                if row["page_id"] != page:
                    page, known = row["page_id"], {}
                if row["kind"] == 0:
                    known[row["digest"]] = row["elected"]
                else:
                    revisit = row["digest"] in known
                    done += files.add(record(page, row["url"], row["html"].encode(), known.get(row["digest"]), revisit))
            if done:
                yield manifest(done)
        if files is not None and files.out is not None:
            yield manifest([files.close()])

    shard, n = shards(rows)
    sharded = both.withColumn("shard", shard).repartition(n, "shard").sortWithinPartitions("shard", order, "kind", "digest", "url")
    sharded.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """RECORDS of the files that the manifest names; payloads are left out without payload."""
    schema = to_arrow(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, folder = pafs.FileSystem.from_uri(f"{path}/records")
                rows, size = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        row = parsed(raw)
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file")
    # with a number, for a few bytes of names would else be merged into one task that reads all
    return files.repartition(min(READERS, max(1, files.count())), "file").mapInArrow(run, RECORDS)


def warc_rows(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives just written."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path, payload=False).drop("url", "payload")
