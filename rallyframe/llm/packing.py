"""Bounded-space online best-fit packing of token sequences.

A document is its ids with an end id. Only documents longer than a sequence are cut, into
full pieces after a first piece that may be shorter. Full pieces are sequences of their
own. All others go through a packer with a fixed number of open sequences: a bitset over
free space says which amounts are on offer, a piece goes to the open sequence with the
least free space that holds it, and when a new one is needed and none may be opened, the
fullest closes. Pieces come in the order of a hash, and each run of as many as may be open
goes longest first: every run has long and short pieces, however many a task packs.

Nulls: a null text is a document of its end id alone; repeated rows are packed once each;
an empty table gives no pieces; null doc_ids are packed like others.

Plan: texts are tokenised where they are read and do not move. Only (doc_id, piece,
start, length, crc32) rows are shuffled, by a hash of all of them, so that no key is hot;
each task packs its share with memory for OPEN sequences and streams its input. What a task
leaves open at its end is at most OPEN sequences, however many pieces it packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, map_batches, texts_of, to_arrow
from .tokens import encoder

SEQUENCE = 2048
END_ID = 0
OPEN = 4096
PIECES = columns(doc_id="long", piece="int", start="long", length="long", ids_crc32="long")
PACKED = columns(doc_id="long", piece="int", start="long", length="long", ids_crc32="long", sequence_id="long", offset="long")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % size or min(n, size)
    return [(0, first), *((i, size) for i in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """PIECES of every document of docs."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in PIECES}
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(texts_of(batch)), strict=True):
            ids += end
            for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                row = (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), PIECES, each)


class Packer:
    """Open sequences by free space; ``free`` is the bitset of amounts on offer."""

    def __init__(self, size: int, most_open: int, first_id: int):
        self.size, self.most_open, self.next_id = size, most_open, first_id
        self.free, self.n_open = 0, 0
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """(sequence_id, offset) for a piece."""
        fitting = self.free >> length
        if fitting:
            room = length + ((fitting & -fitting).bit_length() - 1)
            sequence = self._take(room)
        else:
            if self.n_open == self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            room, sequence = self.size, self.next_id
            self.next_id += 1
        if room > length:
            left = room - length
            self.open[left].append(sequence)
            self.free |= 1 << left
            self.n_open += 1
        return sequence, self.size - room

    def _take(self, room: int) -> int:
        sequence = self.open[room].pop()
        if not self.open[room]:
            self.free &= ~(1 << room)
        self.n_open -= 1
        return sequence


def runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of n rows, the last of which may be shorter."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= n:
            rows = pa.Table.from_batches(held)
            whole = rows.num_rows // n * n
            yield from (rows.slice(i, n) for i in range(0, whole, n))
            held = rows.slice(whole).to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def pack(parts: DataFrame, size: int = SEQUENCE, most_open: int = OPEN) -> DataFrame:
    """PACKED for PIECES: a sequence and a place in it for each piece."""
    schema = to_arrow(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for several in runs(batches, most_open):
            rows = several.sort_by([("length", "descending")]).to_pydict()
            part = rows.pop("part")[0]
            if packer is None:
                packer = Packer(size, most_open, part << 40)
            placed = [packer.put(n) for n in rows["length"]]
            rows["sequence_id"], rows["offset"] = [x[0] for x in placed], [x[1] for x in placed]
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    dealt = parts.repartition("doc_id", "piece", "ids_crc32").withColumn("part", F.spark_partition_id().cast("long"))
    dealt = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, PACKED)


def packed_rows(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    return pack(pieces(docs, tokenizer, size), size)
