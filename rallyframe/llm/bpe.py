"""BPE encoding and decoding with a pair occurrence index.

The vocabulary and merge ranks come from a tokenizers JSON file (NFC, white space runs as
one space, lower case; word-end suffix; byte-level symbols). The words of a batch that are new
to the worker lie in one array of symbols. An index maps each pair with a rank to all
its positions in that array. Ranks with positions are active; they are applied in ascending
order, each to all its positions at once, and the lists of the pairs that a merge makes
are extended. A merge only makes pairs of higher rank, so one pass over the ranks does.

Decoding joins the ids' symbols with one space, as that file (which names no decoder) does.

Nulls: a null text counts as empty and has no ids. Rows are independent: repeated rows
repeat their results, and extra columns are not read.

Plan: narrow; texts are encoded where they are read. A worker keeps at most WORDS_KEPT words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .shared import columns, map_batches, texts_of
from .tokens import CONTRACTIONS, LETTERS, NUMBERS, SPACES

WORDS_KEPT = 1_000_000
#: Bytes that stand for themselves among byte-level symbols.
PRINTABLE = ((33, 126), (161, 172), (174, 255))

SIMPLE = re.compile("[^\x00-\xff]")
SPLIT = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
DIGEST = columns(doc_id="long", n_tokens="long", ids_sha256="str", decoded_sha256="str")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = {b for a, z in PRINTABLE for b in range(a, z + 1)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class PairIndexBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max(max(vocab.values()), *(x["id"] for x in spec["added_tokens"])) + 1
        self.symbols = [""] * self.size
        for symbol, i in vocab.items():
            self.symbols[i] = symbol
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for symbol, i in self.specials.items():
            self.symbols[i] = symbol
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        by_byte = byte_symbols()
        self.inner = np.array([vocab[c] for c in by_byte], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in by_byte], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.left, self.right = left.tolist(), right.tolist()
        self.merged = [vocab[a + b] for a, b in merges]
        self.pairs, first = np.unique(left * self.size + right, return_index=True)
        self.ranks = first.astype(np.int64)
        library = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer[0]
        self.decimal = [str(i) for i in range(self.size)]
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Normalised pieces. Beyond Latin-1 the library's own tables of characters decide."""
        if SIMPLE.search(text):
            return [w for w, _ in self.split.pre_tokenize_str(self.normalise(text))]
        return SPLIT.findall(re.sub(f"[{SPACES}]+", " ", text).lower())

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(x) for x in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        n = len(symbol)
        before, after = np.arange(n) - 1, np.arange(n) + 1
        before[np.concatenate([[0], ends[:-1]])] = -1
        after[ends - 1] = -1
        alive = np.ones(n, dtype=bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def extend(rank: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, spots in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(spots)

        start = np.flatnonzero(after >= 0)
        rank = self._ranks_of(symbol[start], symbol[start + 1])
        if (rank >= 0).any():
            extend(rank[rank >= 0], start[rank >= 0])
        while active:
            r = heapq.heappop(active)
            spots = index.pop(r)
            at = np.unique(np.concatenate(spots))
            a, b, whole = self.left[r], self.right[r], self.merged[r]
            at = at[alive[at] & (symbol[at] == a)]
            nxt = after[at]
            ok = nxt >= 0
            at, nxt = at[ok], nxt[ok]
            ok = symbol[nxt] == b
            at, nxt = at[ok], nxt[ok]
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair goes
                chained = np.concatenate([[False], at[1:] == nxt[:-1]])
                begins = np.flatnonzero(~chained)
                place = np.arange(len(at)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(at)]])))
                at, nxt = at[place % 2 == 0], nxt[place % 2 == 0]
            if not len(at):
                continue
            symbol[at] = whole
            alive[nxt] = False
            far = after[nxt]
            after[at] = far
            inside = far >= 0
            before[far[inside]] = at[inside]
            left = before[at]
            has = left >= 0
            spots = np.concatenate([left[has], at[inside]])
            if not len(spots):
                continue
            rank = self._ranks_of(symbol[spots], symbol[after[spots]])
            good = rank >= 0
            if good.any():
                extend(rank[good], spots[good])
        ids = symbol[alive].astype("<u4")
        counts = np.add.reduceat(alive.astype(np.int64), np.concatenate([[0], ends[:-1]]))
        stops = (4 * np.cumsum(counts)).tolist()
        flat = ids.tobytes()
        return [flat[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a special token's string stands for its id."""
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        split = []
        for text in texts:
            parts = self.special_split.split(text) if self.special_split and self.special_split.search(text) else [text]
            split.append([x for i, part in enumerate(parts) for x in ([part] if i % 2 else self.words(part))])
        new = list({w for ws in split for w in ws if w not in known})
        for content, i in self.specials.items():
            if content in new:
                new.remove(content)
                known[content] = np.array([i], dtype="<u4").tobytes()
        if new:
            known.update(zip(new, self.encode_words(new), strict=True))
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.symbols.__getitem__, ids))


_models: dict[str, PairIndexBPE] = {}


def model(path: str) -> PairIndexBPE:
    """One model for each file and Python worker."""
    if path not in _models:
        _models[path] = PairIndexBPE(path)
    return _models[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the ids of every whole text."""

    def each(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "ids": [np.frombuffer(x, "<u4").tolist() for x in model(path).encode(texts_of(batch))]}

    return map_batches(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), columns(doc_id="long", ids=T.ArrayType(T.LongType())), each)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the ids of each row back as text."""

    def each(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "text": [model(path).decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_batches(ids.select("doc_id", "ids"), columns(doc_id="long", text="str"), each)


def bpe_rows(docs: DataFrame, path: str) -> DataFrame:
    """DIGEST: ids of every whole text and their decoding, as digests made where the text is."""

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        m = model(path)
        for raw in m.encode(texts_of(batch)):
            ids = np.frombuffer(raw, "<u4").tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(m.decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
        return {"doc_id": batch.column(0)} | out

    return map_batches(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), DIGEST, each)
