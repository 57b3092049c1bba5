"""Token ids in files of byte planes.

A shard is a range of doc_ids, written as one run of ids. The run is cut into blocks of
BLOCK ids; a block is transposed into four byte planes, each compressed with zstandard.
A row of the file holds one block: shard, place of its first id in the shard, number of
ids, the four planes, and the block's part of the document index (doc_id, place in the
document, ids). The container is Parquet written by Spark, so that a shard appears whole or not at all,
whatever store it is on and whichever executors are lost. A second, small table is the chunk index:
ids and blocks of each shard.

Nulls: a null text is a document of its end id alone; null doc_ids come first. Rows that
share a doc_id come in the order of their texts and are told apart by a running number within the shard. An empty table makes
an empty file.

Plan: one range shuffle of texts by doc_id; shards stream through a task with one block in
memory. Reading needs no shuffle but for documents that a block boundary cuts. The running total
over shards is taken from the chunk index: one row a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns, map_batches, new_path, texts_of, to_arrow, written
from .tokens import encoder

BLOCK = 1 << 16
END_ID = 0
LEVEL = 3
PLACES = T.ArrayType(columns(doc_id="long", row="long", at="long", n="long", total="long"))
BLOCKS = columns(shard="long", first="long", n_ids="long", plane0="bytes", plane1="bytes", plane2="bytes", plane3="bytes", docs=PLACES)
PARTS = columns(shard="long", row="long", doc_id="long", at="long", first="long", n="long", total="long", ids="bytes", ids_crc32="long")


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Four compressed byte planes of little-endian unsigned 32-bit ids."""
    pack = zstandard.ZstdCompressor(level=LEVEL)
    return [pack.compress(np.ascontiguousarray(x).tobytes()) for x in ids.view(np.uint8).reshape(-1, 4).T]


def from_planes(planes: list[bytes]) -> bytes:
    unpack = zstandard.ZstdDecompressor()
    return np.ascontiguousarray(np.stack([np.frombuffer(unpack.decompress(x), np.uint8) for x in planes], axis=1)).tobytes()


def write_planes(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block: int = BLOCK) -> None:
    """Writes the ids of docs, in ascending doc_id order, to path."""
    end, schema = np.array([end_id], dtype="<u4").tobytes(), to_arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, row, rest, index = None, 0, 0, bytearray(), []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, index
            done = 0
            while len(rest) - done >= 4 * block or (last and done < len(rest)):
                n = min(block, (len(rest) - done) // 4)
                own, later, room = [], [], n
                for doc_id, r, at, total in index:
                    take = min(total - at, room)
                    if take:
                        own.append({"doc_id": doc_id, "row": r, "at": at, "n": take, "total": total})
                        room -= take
                    if at + take < total:
                        later.append((doc_id, r, at + take, total))
                values = [shard, first, n, *to_planes(np.frombuffer(bytes(rest[done : done + 4 * n]), dtype="<u4")), own]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
                index, first, done = later, first + n, done + 4 * n
            del rest[:done]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_pylist()
            shard = batch.column(2)[0].as_py() if shard is None else shard
            texts = texts_of(batch)
            for k in range(0, len(rows), 64):
                for doc_id, ids in zip(rows[k : k + 64], encoder(tokenizer).encode(texts[k : k + 64]), strict=True):
                    rest += ids
                    rest += end
                    index.append((doc_id, row, 0, len(ids) // 4 + 1))
                    row += 1
                if len(rest) >= 4 * block:
                    yield from out(False)
        yield from out(True)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))).withColumn("shard", F.spark_partition_id().cast("long"))
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks")
    blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.count("*").alias("n_blocks")).coalesce(1).write.parquet(f"{path}/chunk_index")


def read_planes(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """PARTS: the ids of each document, in as many parts as blocks that hold some.

    With digest, a document that lies in one block comes with its crc32 in place of its ids.
    """

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in PARTS}
        for b in batch.to_pylist():
            ids, place = from_planes([b[f"plane{i}"] for i in range(4)]), 0
            for d in b["docs"]:
                own = ids[4 * place : 4 * (place + d["n"])]
                brief = digest and d["n"] == d["total"]
                row = (b["shard"], d["row"], d["doc_id"], d["at"], b["first"] + place, d["n"], d["total"], None if brief else own, zlib.crc32(own) if brief else None)
                place += d["n"]
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        return out

    return map_batches(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), PARTS, each)


def _joined(parts: DataFrame) -> DataFrame:
    """One row for each document that block boundaries cut, with the crc32 of its parts in order."""

    def each(batch: pa.RecordBatch) -> dict:
        crcs = []
        for several in batch.column(4).to_pylist():
            crc = 0
            for x in sorted(several, key=lambda x: x["at"]):
                crc = zlib.crc32(x["ids"], crc)
            crcs.append(crc)
        return dict(zip(("shard", "doc_id", "first", "total"), batch.columns, strict=False)) | {"ids_crc32": crcs}

    several = parts.groupBy("shard", "row", "doc_id").agg(F.min("first").alias("first"), F.max("total").alias("total"), F.collect_list(F.struct("at", "ids")).alias("several"))
    schema = columns(shard="long", doc_id="long", first="long", total="long", ids_crc32="long")
    return map_batches(several.select("shard", "doc_id", "first", "total", "several"), schema, each)


def plane_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files just written."""
    spark = docs.sparkSession
    path = new_path(spark, "planes")
    write_planes(docs, tokenizer, path)
    index = spark.read.parquet(f"{path}/chunk_index")  # one row a shard
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(read_planes(spark, path, digest=True), "parts")
    whole = parts.filter("ids is null").select("shard", "doc_id", "first", "total", "ids_crc32")
    ended = whole.unionByName(_joined(parts.filter("ids is not null")))
    placed = ended.join(index.select("shard", before.alias("before")), "shard")
    return placed.select("doc_id", (F.col("first") + F.col("before")).alias("start"), F.col("total").alias("n_tokens"), "ids_crc32")
