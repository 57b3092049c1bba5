"""Language identification with bit-sliced Bloom filters of byte n-grams.

Each language learns the GRAMS most frequent four-byte grams of its texts (by the
texts that hold them). One table of bit masks holds the filters of all languages: a row has one bit a
language, and a gram sets its language's bit in HASHES rows. Looking a gram up is the bitwise
and of its rows: the mask of all languages that contain it. A text's masks are counted by
language over all its grams; counts are corrected for each filter's false positive rate, and
the language with the most decides. The score is its share of all corrected counts.

Learning uses text and non-null lang of documents whose crc32(doc_id as text) mod 4 is not 2, at most about SAMPLE
a language (chosen by a hash of doc_id, or of the text where that is null, so the same on every run), for every language there is. A prediction reads the text alone.

Nulls: a null text, and one without letters, is ``und`` with score 0; a null lang is not learnt; a null doc_id is
not held out. Without anything learnt all is ``und``. Ties go to the first language by name. Repeated
rows repeat their results.

Plan: the sample is a filter where texts are read, so texts don't move; its grams are counted per batch, then summed by (lang, gram); the tables that go to tasks have
GRAMS numbers a language (a table of n languages: about 16 * GRAMS * n / 8 bytes). Prediction is one pass where texts are read, in pieces of CHUNK bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, map_batches, texts_of

UNKNOWN = "und"
SAMPLE = 3000
GRAMS = 6000
HASHES = 3
ROWS_PER_GRAM = 16
CHUNK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
COUNTS = columns(lang="str", gram="long", n="long")
PREDICTED = columns(doc_id="long", held_out="bool", lang_pred="str", score="double")
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def grams(data: np.ndarray) -> np.ndarray:
    """The four-byte gram at each place."""
    wide = data.astype(np.uint32)
    n = max(0, len(data) - 3)
    return wide[:n] | wide[1 : 1 + n] << np.uint32(8) | wide[2 : 2 + n] << np.uint32(16) | wide[3 : 3 + n] << np.uint32(24)


def plain(text: str) -> bytes:
    return f" {text.lower()} ".encode().replace(b"\n", b" ")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, gram, n: in how many of the sampled texts of a language a gram occurs."""
    rows = docs.filter("text is not null and lang is not null").filter(~held_out()).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count().collect()  # a row a language
    shares = [x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))]
    share = F.try_element_at(F.create_map(*shares), F.col("lang")) if shares else F.lit(0.0)
    own = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))  # a null adds nothing to the hash
    draw = F.pmod(own, F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(draw < share).select("lang", "text")

    def each(batch: pa.RecordBatch) -> dict:
        found: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            if LETTER.search(text):
                found.setdefault(lang, []).append(np.unique(grams(np.frombuffer(plain(text), np.uint8))))
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang, parts in found.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            out["lang"] += [lang] * len(gram)
            out["gram"] += gram.tolist()
            out["n"] += n.tolist()
        return out

    return map_batches(chosen, COUNTS, each).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters: table[word][row] has a bit for each of 64 languages, and there are as many words as languages need."""

    def __init__(self, learnt: dict[str, list[int]]):
        self.langs = sorted(learnt)
        most = max(map(len, learnt.values()), default=1)
        self.bits = max(10, int(np.ceil(np.log2(ROWS_PER_GRAM * most))))
        words = max(1, -(-len(self.langs) // 64))
        kind = np.uint8 if len(self.langs) <= 8 else np.uint64
        self.table = np.zeros((words, 1 << self.bits), dtype=kind)
        self.false = np.zeros(len(self.langs))
        for i, lang in enumerate(self.langs):
            bit = kind(1 << i % 64)
            for row in self.rows(np.array(learnt[lang], dtype=np.uint32)):
                self.table[i // 64][row] |= bit
            self.false[i] = ((self.table[i // 64] & bit) != 0).mean() ** HASHES

    def rows(self, gram: np.ndarray):
        wide = gram.astype(np.uint64)
        for m in MIX[:HASHES]:
            yield (wide * m) >> np.uint64(64 - self.bits)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Corrected counts by text and language."""
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.zeros(len(texts))
        pieces, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):
                piece = text[at : at + CHUNK + 3]
                if size + len(piece) > CHUNK and pieces:
                    self._add(pieces, out, sizes)
                    pieces, size = [], 0
                pieces.append((i, piece))
                size += len(piece)
        if pieces:
            self._add(pieces, out, sizes)
        return np.maximum(0, out - sizes[:, None] * self.false) / (1 - self.false)

    def _add(self, pieces: list[tuple[int, bytes]], out: np.ndarray, sizes: np.ndarray) -> None:
        gram = grams(np.frombuffer(b"".join(x for _, x in pieces), np.uint8))
        if not len(gram):
            return
        rows = list(self.rows(gram))
        starts = np.cumsum([0] + [len(x) for _, x in pieces[:-1]])
        starts = np.minimum(starts, len(gram) - 1)
        owner = np.array([i for i, _ in pieces])
        # grams across two pieces are left out
        own = np.ones(len(gram), dtype=bool)
        for back in (1, 2, 3):
            own[starts[1:] - back] = False
        sizes_here = np.add.reduceat(own.astype(np.int64), starts)
        np.add.at(sizes, owner, sizes_here)
        for w in range(len(self.table)):
            mask = self.table[w][rows[0]]
            for row in rows[1:]:
                mask &= self.table[w][row]
            mask[~own] = 0
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                hit = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                np.add.at(out[:, i], owner, np.add.reduceat(hit, starts, dtype=np.int64))


def learnt(docs: DataFrame, sample: int = SAMPLE, most: int = GRAMS) -> Filters:
    """Filters of the languages of docs (doc_id, text, lang)."""
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = gram_counts(docs, sample).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)
    rows = top.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # at most ``most`` numbers a language
    return Filters({r["lang"]: r["grams"] for r in rows})


def predicted(docs: DataFrame, filters: Filters) -> DataFrame:
    """PREDICTED for every whole text of docs."""

    def each(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        counts = filters.counts([plain(x) for x in texts])
        langs, scores = [], []
        for text, row in zip(texts, counts, strict=True):
            total = float(row.sum())
            if total <= 0 or not LETTER.search(text):
                known = bool(filters.langs) and LETTER.search(text) is not None
                langs.append(filters.langs[0] if known else UNKNOWN)
                scores.append(0.0)
            else:
                langs.append(filters.langs[int(row.argmax())])
                scores.append(float(row.max()) / total)
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": langs, "score": scores}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out")), PREDICTED, each)


def language_rows(docs: DataFrame) -> DataFrame:
    return predicted(docs, learnt(docs))
