"""Alignment of two tokenizers over all documents, and how often each pair of their ids is linked.

Both tokenizers work on units (white space and the word after it) apart from each other, and units repeat, so a worker keeps what it has learnt of a unit. All units of a
block that are new to it are encoded by both, and the ends of their tokens in bytes make two long rising arrays. These are aligned by diagonal run skipping: at the current
shift between the two indices, slices of the arrays are compared with lengths that double while they are equal and halve after that, so that one-to-one
stretches are jumped; where they stop, the smaller end moves on until both meet, that irregular group is kept, and the shift is updated.

Counts of id pairs over the corpus must come back to each document. Documents are dealt into chunks (what one task has read, up to UNITS different units); a document is kept as the units
of its chunk with their numbers, a unit as pairs of ids, and a chunk hands on each of its pairs once with its count. Pairs are summed over all chunks, the
highest count of each B id is found, both come back to the chunks by pair, and a chunk's documents are summed from them. What is shuffled is pairs of chunks and documents in short form;
nothing grows with a word's or a pair's number of places, and no table of pairs is broadcast.

Texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens. Rows need no unique doc_id.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, new_path, to_arrow
from .tokens import UNSURE

#: Different units of a chunk, documents' units of a chunk, and units and characters that a worker keeps.
UNITS, PLACES, KEPT, KEPT_CHARS = 250_000, 3_000_000, 300_000, 30_000_000
#: Units that are encoded as one text.
JOINED = 1000
#: White space and a word. No piece of either tokenizer goes on past a word, but some of B end in \r, so that is not cut off.
UNIT = re.compile(r"\s*\S+(?:\r\s*\S*)*|\s+")


def group_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The indices after each common end of two rising lists with equal last values, by diagonal run skipping."""
    i_ends, j_ends, i, j, n = [], [], 0, 0, len(a)
    while i < n:
        if a[i] == b[j]:
            step = 1
            while i < n and a[i : i + step] == b[j : j + step]:  # slices at the current shift; at the end of either they are unequal or complete
                k = min(step, n - i)
                i_ends += range(i + 1, i + k + 1)
                j_ends += range(j + 1, j + k + 1)
                i, j, step = i + k, j + k, 2 * step
            while step > 1 and i < n:
                step //= 2
                if a[i : i + step] == b[j : j + step]:
                    k = min(step, n - i)
                    i_ends += range(i + 1, i + k + 1)
                    j_ends += range(j + 1, j + k + 1)
                    i, j = i + k, j + k
        else:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
            i_ends.append(i)
            j_ends.append(j)
    return i_ends, j_ends


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others for those from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}


class Aligner:
    """What both tokenizers make of a unit: (n_a, n_b, n_groups, groups as text with a semicolon after each, an array of pairs, and where its own begin and end there), or None if a tokenizer does not give it back."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet.get(c, 63) for c in token) for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        named = lambda n, sign: np.array([f"{i}{sign}" for i in range(n)], object)
        self.a_named, self.b_named = (named(len(self.a_size), ","), named(len(self.a_size), "|")), (named(len(pieces), ","), named(len(pieces), ";"))
        self.lone = self.b.piece_to_id("▁")
        self.whole_only = any(re.search("[^\\s▁][^\\S\r]|[^\\s▁]▁|▁[^\\S\r]", p) for p in pieces)
        self.known: dict[str, tuple | None] = {}
        self.alone: set[str] = set()
        self.chars = 0

    def units(self, text: str) -> list[str]:
        """Units of a space and the text, which no token of either tokenizer crosses."""
        if self.whole_only or UNSURE.search(text):
            self.alone.add(" " + text)
            return [" " + text]
        return UNIT.findall(" " + text)

    def learn(self, units: list[str]) -> None:
        """Aligns the units that are not known. Units whose neighbours cannot change them are encoded JOINED at a time, as they would stand in a text."""
        new = [u for u in units if u not in self.known]
        self.chars += sum(map(len, new))
        if len(self.known) + len(new) > KEPT or self.chars > KEPT_CHARS:
            self.known, new = {}, units
            self.chars = sum(map(len, new))
        inner = [u for u in new if u[0] in " \n" and not u[-1].isspace() and u not in self.alone]
        inner.sort(key=lambda u: u[0] != " ")  # a text begins with a space
        alone = set(new).difference(inner)
        for k in range(0, len(inner), JOINED * 50):
            block = [inner[x : x + JOINED] for x in range(k, min(k + JOINED * 50, len(inner)), JOINED)]
            alone.update(*self._encode(block))
        self._encode([[u] for u in alone], last=True)
        self.alone.clear()

    def _encode(self, texts: list[list[str]], last: bool = False) -> list[list[str]]:
        """Learns the units of texts of units; those of texts that do not come back are None if this is their last chance, and else returned."""
        whole = ["".join(t) for t in texts]
        a = [x.ids for x in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        # B puts a space before a text that is not empty: its own first space, or one that is taken off again
        plain = self.b.encode([x[1:] if x[0] == " " else x for x in whole], num_threads=1)
        b = [[self.lone] if x == " " else ids if x[0] == " " else ids[1:] if ids[0] == self.lone else [] for x, ids in zip(whole, plain, strict=True)]
        back = [b"".join(map(self.a_bytes.__getitem__, i)) == x.encode() == b"".join(map(self.b_bytes.__getitem__, j)) for x, i, j in zip(whole, a, b, strict=True)]
        kept = [k for k, good in enumerate(back) if good]
        if kept:
            self._align([u for k in kept for u in texts[k]], np.concatenate([np.array(a[k], np.int64) for k in kept]), np.concatenate([np.array(b[k], np.int64) for k in kept]))
        lost = [texts[k] for k, good in enumerate(back) if not good]
        if last:
            self.known.update(dict.fromkeys(u for t in lost for u in t))
        return lost

    def _align(self, units: list[str], a_ids: np.ndarray, b_ids: np.ndarray) -> None:
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        i_ends, j_ends = map(np.array, group_ends(a_ends.tolist(), b_ends.tolist()))
        n_i, n_j = np.diff(i_ends, prepend=0), np.diff(j_ends, prepend=0)
        said = np.empty(len(a_ids) + len(b_ids), object)  # a group's A ids, then its B ids, group after group
        for ids, names, ends, place in ((a_ids, self.a_named, i_ends, np.repeat(j_ends - n_j, n_i)), (b_ids, self.b_named, j_ends, np.repeat(i_ends, n_j))):
            words = names[0][ids]
            words[ends - 1] = names[1][ids[ends - 1]]
            said[np.arange(len(ids)) + place] = words
        said = said.tolist()
        either = np.union1d(a_ends, b_ends)  # within a group, each end of either side is the end of one link
        codes = a_ids[np.searchsorted(a_ends, either)] << 32 | b_ids[np.searchsorted(b_ends, either)]
        unit_ends = np.cumsum([len(u.encode()) for u in units])
        common = np.searchsorted(a_ends[i_ends - 1], unit_ends)  # the group that ends with each unit
        if not (a_ends[i_ends - 1][common] == unit_ends).all():
            raise ValueError("a token crosses the end of a unit")
        a_unit, b_unit = i_ends[common], j_ends[common]
        counts = [np.diff(x, prepend=0).tolist() for x in (a_unit, b_unit, common + 1)]
        links = [0, *np.searchsorted(either, unit_ends, "right").tolist()]
        at = 0
        for k, (unit, x, y, n, end) in enumerate(zip(units, *counts, (a_unit + b_unit).tolist(), strict=True)):
            self.known[unit] = (x, y, n, "".join(said[at:end]), codes, links[k], links[k + 1])
            at = end


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for each pair of files and Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


OWN = ("n_a", "n_b", "n_groups", "n_links")
#: part: doc (a document in units of its chunk), unit (all units of a chunk in pairs of the chunk) or pair (id pair, its number in the chunk, its count there).
ALIGNED = columns(part="str", chunk="long", doc_id="long", **dict.fromkeys(OWN, "long"), groups_sha256="str", units="bytes", times="bytes", pair="long", number="int", n="long")


class _Chunk:
    """The units that a chunk's documents have used so far, numbered as they came."""

    def __init__(self):
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.said: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.sums, self.lost, self.totals, self.places = np.zeros((0, 4), np.int64), np.zeros(0, bool), np.zeros(0, np.int64), 0

    def documents(self, split: list[list[str]], tool: Aligner) -> list[tuple]:
        """For each list of units OWN, the digest of its groups, and its units with their numbers of times; a text that is not given back has none."""
        before = len(self.numbers)
        numbered = [np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units)) for units in split]
        new = list(islice(reversed(self.numbers), len(self.numbers) - before))[::-1]
        tool.learn(new)
        made = [tool.known[u] or (0, 0, 0, "", NO_PAIRS, 0, 0) for u in new]
        self.said += [x[3] for x in made]
        self.pairs += [x[4][x[5] : x[6]] for x in made]
        self.sums = np.concatenate([self.sums, np.array([(*x[:3], x[6] - x[5]) for x in made], np.int64).reshape(-1, 4)])
        self.lost = np.concatenate([self.lost, np.array([not x[0] for x in made], bool)])
        self.totals = np.concatenate([self.totals, np.zeros(len(new), np.int64)])
        return [self._document(own) for own in numbered]

    def _document(self, own: np.ndarray) -> tuple:
        if not len(own) or self.lost[own].any():
            return 0, 0, 0, 0, "", b"", b""
        digest = hashlib.sha256("".join(map(self.said.__getitem__, own.tolist()))[:-1].encode()).hexdigest()
        own, times = np.unique(own, return_counts=True)
        self.totals[own] += times
        self.places += len(own)
        return *(times @ self.sums[own]).tolist(), digest, np.diff(own, prepend=0).astype("<u4").tobytes(), times.astype("<u4").tobytes()


NO_PAIRS = np.zeros(0, np.int64)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The table of chunks (see ALIGNED), written once; its rows come back by part."""
    arrow = to_arrow(ALIGNED)

    def batch_of(part: str, chunk: int, **values) -> pa.RecordBatch:
        n = len(next(iter(values.values())))
        whole = values | {"part": [part] * n, "chunk": [chunk] * n}
        return pa.RecordBatch.from_arrays([pa.array(whole[f.name], f.type) if f.name in whole else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def end(held: _Chunk, chunk: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in held.pairs], np.int64)
        codes, number = np.unique(np.concatenate([np.zeros(0, np.int64), *held.pairs]), return_inverse=True)
        n = np.zeros(len(codes), np.int64)
        np.add.at(n, number, np.repeat(held.totals, sizes))
        yield batch_of("unit", chunk, units=[number.astype("<u4").tobytes()], times=[sizes.astype("<u4").tobytes()], n=[len(codes)])
        for k in range(0, len(codes), 100_000):
            yield batch_of("pair", chunk, pair=codes[k : k + 100_000], number=np.arange(k, min(k + 100_000, len(codes)), dtype=np.int32), n=n[k : k + 100_000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, chunk, held = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text"))
            for k in range(0, len(texts), 500):
                rows = held.documents([tool.units(t) if t else [] for t in texts[k : k + 500]], tool)
                values = {n: [r[i] for r in rows] for i, n in enumerate((*OWN, "groups_sha256", "units", "times"))}
                yield batch_of("doc", chunk, doc_id=ids[k : k + 500], **values)
                if len(held.numbers) > UNITS or held.places > PLACES:
                    yield from end(held, chunk)
                    chunk, held = chunk + 1, _Chunk()
        yield from end(held, chunk)

    path = new_path(docs.sparkSession, "aligned")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(ALIGNED).parquet(path)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (A's id in the upper half, B's in the lower), n links of it in all documents, and best: whether no pair of the same B id has more."""
    counts = chunks.filter("part = 'pair'").groupBy("pair").agg(F.sum("n").alias("n"))
    low = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(low.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", low).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


LINKED = columns(doc_id="long", **dict.fromkeys(OWN, "long"), n_best="long", count_sum="long", groups_sha256="str")


def linked(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of one chunk's documents from its units (left) and its pairs with their counts over the corpus (right)."""
    unit, docs = None, []
    for r in left.to_pylist():
        if r["part"] == "unit":
            unit = r
        else:
            docs.append(r)
    number, sizes = (np.frombuffer(unit[c], "<u4").astype(np.int64) for c in ("units", "times"))
    at, order = np.concatenate([[0], np.cumsum(sizes)])[:-1], right.column("number").to_numpy()
    per_unit = []
    for name in ("best", "n"):
        value = np.zeros(unit["n"] + 1, np.int64)
        value[order] = right.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(value[number])])
        per_unit.append(sums[at + sizes] - sums[at])
    out: dict[str, list] = {f.name: [] for f in LINKED}
    for r in docs:
        own, times = np.cumsum(np.frombuffer(r["units"], "<u4").astype(np.int64)), np.frombuffer(r["times"], "<u4").astype(np.int64)
        sums = {n: int((x[own] * times).sum()) for n, x in zip(("n_best", "count_sum"), per_unit, strict=True)}
        for name in out:
            out[name].append(sums[name] if name in sums else r[name])
    schema = to_arrow(LINKED)
    return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def aligned_rows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a document: doc_id, tokens of both, groups, links, links of B ids' most frequent pairs, the sum of the links' counts, and a digest of the groups."""
    chunks = aligned(docs, a_path, b_path)
    counts = pair_counts(chunks).withColumnRenamed("n", "total")
    back = chunks.filter("part = 'pair'").select("chunk", "pair", "number").join(counts, "pair").select(F.col("chunk").alias("of_chunk"), "number", F.col("total").alias("n"), "best")
    rows = chunks.filter("part <> 'pair'").select("part", "chunk", "doc_id", *OWN, "groups_sha256", "units", "times", "n")
    return rows.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(linked, LINKED)
