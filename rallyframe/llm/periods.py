"""Periodic runs of words: stretches that repeat one block three times or more.

Scale-tiled. The periods are taken octave by octave: for periods of P to 2 P - 1 words a text is cut into tiles of
TILE x P words that overlap by six P or more, so that every run leaves a piece of at least its least length in each tile it
crosses, and pieces of neighbouring tiles share more than a period. Tiles are solved apart from each other: every run holds one of the
boundaries that lie in steps in its tile, and the values of the Z-function at that boundary, read forwards and backwards for the
octave's shifts, give the run's ends. Most shifts are refused at once by comparing eight words. Pieces (document, period, start, end) are then shuffled
by document and period and stitched into runs. Work is n log n in the words of a text, whatever repeats in it; a text is held by one task
(it is one value of a row), but tiles and shifts only in blocks of PAIRS.

Common prefixes are found by bisection over two 31-bit polynomial fingerprints (62 bits together) of word numbers, which are exact within a block of texts.

Nulls and texts without words have no runs. Rows are told apart by ``keyed``, so repeated or missing doc_ids do no harm.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns, keyed, map_batches, to_arrow, written

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Words that are compared before a shift is looked at; a tile's own words, in periods; shifts looked at together; words of a block of texts.
PROBE, TILE, PAIRS, BLOCK = 8, 24, 4_000_000, 300_000
MODS = (2147483647, 2147483629)

#: (doc_id, number of words) to a place and a period, or None (see ``periodic_rows``).
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def _fingerprints(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each modulus: sums of id x base ** place over the places before each, powers of the base, the modulus."""
    out = []
    for k, mod in enumerate(MODS):
        powers = np.ones(len(ids) + 1, np.uint64)
        base, done = np.uint64(1_000_003 + 7919 * k), 1
        while done < len(powers):  # doubling: powers[done:2 done] = powers[:done] x base ** done
            step = np.uint64(pow(int(base), done, mod))
            powers[done : 2 * done] = powers[: len(powers) - done][:done] * step % np.uint64(mod)
            done *= 2
        values = (ids.astype(np.uint64) * np.uint64(2_654_435_761 + 2 * k) + np.uint64(12_345 + k)) % np.uint64(mod)
        out.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:-1] % np.uint64(mod), dtype=np.uint64)]), powers, mod))
    return out


def _same(prints, a: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words at a .. a + length equal those ``shift`` further on."""
    good = np.ones(len(a), bool)
    for sums, powers, mod in prints:
        m = np.uint64(mod)
        good &= (sums[a + length] - sums[a]) % m * powers[shift] % m == (sums[a + shift + length] - sums[a + shift]) % m
    return good


def _z_forwards(prints, at, shift, most) -> np.ndarray:
    """How many words from ``at`` on equal those ``shift`` further on, ``most`` at most."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        good = _same(prints, at, shift, mid)
        low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
    return low


def _z_backwards(prints, at, shift, most) -> np.ndarray:
    """The same for the words before ``at``."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        good = _same(prints, at - mid, shift, mid)
        low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
    return low


def _least_primes(n: int) -> np.ndarray:
    """The smallest prime divisor of each number below n (0 and 1 stand for themselves)."""
    out = np.arange(n)
    for r in range(2, int(n**0.5) + 1):
        if out[r] == r:
            own = out[r * r :: r]
            own[own == np.arange(r * r, n, r)] = r
    return out


def _blocks_repeat(prints, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` words from ``at`` on are one shorter block several times; then nothing of that period has it as its smallest."""
    repeat, rest = np.zeros(len(at), bool), length.copy()
    least = _least_primes(int(length.max(initial=0)) + 1)
    while (open_ := np.flatnonzero(~repeat & (rest > 1))).size:
        prime = least[rest[open_]]
        block = length[open_] // prime
        repeat[open_] = _same(prints, at[open_], block, length[open_] - block)
        rest[open_] //= prime
    return repeat


def fragments(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, start, end) of the periodic pieces of each tile of texts that lie one after the other in ids; starts has one more entry than there are texts.

    Periods are smallest ones. Starts and ends count from the text's first word; pieces of a run in neighbouring tiles overlap by its period or more.
    """
    lengths = np.diff(starts)
    probe = ids.astype(np.uint64) + np.uint64(1)
    probe = np.concatenate([probe, np.zeros(2 * int(lengths.max(initial=0)) + 4 * PROBE, np.uint64)])
    for step in (1, 2, 4):  # probe[i] names the PROBE words from i on
        probe[:-step] = probe[:-step] * np.uint64(0x9E3779B97F4A7C15) + (probe[step:] ^ (probe[step:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    prints, found, p = None, [], 1
    while (texts := np.flatnonzero(lengths >= max(LEAST, TIMES * p))).size:
        overlap, own = max(LEAST, 2 * TIMES * p), max(128, TILE * p)
        tiles = np.maximum(1, -((overlap - lengths[texts]) // own))
        text = np.repeat(texts, tiles)
        number = np.arange(len(text)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        first = starts[text] + number * own
        last = np.minimum(first + own + overlap, starts[text + 1])
        every = min(max(LEAST - q, (TIMES - 1) * q) for q in {p, min(2 * p - 1, 9), min(2 * p - 1, 8), 2 * p - 1} if q >= p) - PROBE + 1
        steps = np.maximum(1, -((first + p + PROBE - 1 - last) // every))
        tile = np.repeat(np.arange(len(first)), steps)
        at = first[tile] + every * (np.arange(len(tile)) - np.repeat(np.cumsum(steps) - steps, steps))
        window = np.lib.stride_tricks.sliding_window_view(probe, p)
        rows = max(1, PAIRS // p)
        hits = []
        for k in range(0, len(at), rows):
            i, d = np.nonzero(window[at[k : k + rows] + p] == probe[at[k : k + rows], None])
            hits.append((i + k, d + p))
        which, shift = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
        inside = at[which] + shift + PROBE <= last[tile[which]]
        which, shift = which[inside], shift[inside]
        if which.size:
            prints = prints or _fingerprints(ids)
            single = ~_blocks_repeat(prints, at[which], shift)
            which, shift = which[single], shift[single]
            c, t = at[which], tile[which]
            end = c + shift + _z_forwards(prints, c, shift, last[t] - c - shift)
            start = c - _z_backwards(prints, c, shift, c - first[t])
            long = end - start >= np.maximum(LEAST, TIMES * shift)
            t, q, start, end = np.unique(np.stack([t[long], shift[long], start[long], end[long]]), axis=1)
            found.append(np.stack([text[t], q, start - starts[text[t]], end - starts[text[t]]]))
        p *= 2
    joined = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    return joined[0], joined[1], joined[2], joined[3]


PIECE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("period", "start", "end")]))


def solved(docs: DataFrame, rewrite: Rewrite | None) -> DataFrame:
    """key, doc_id, n words, sha256 of the words joined by a space, the tiles' pieces, and, where there are any, the words."""
    schema = columns(key="long", doc_id="long", n="long", sha="str", pieces=PIECE, words="bytes")
    arrow = to_arrow(schema)

    def block(rows: list[tuple]) -> pa.RecordBatch:
        number: dict[bytes, int] = defaultdict(count().__next__)
        out, ids = [], []
        for key, doc_id, words in rows:
            own = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            if rewrite and (change := rewrite(doc_id, len(words))):
                a, p = change
                source = np.arange(len(words))
                source[a:] = a + (source[a:] - a) % p
                words, own = [words[i] for i in source.tolist()], own[source]
            ids.append(own)
            out.append((key, doc_id, words))
        starts = np.cumsum([0, *map(len, ids)])
        pieces: dict[int, list[dict]] = {}
        for text, q, start, end in zip(*(x.tolist() for x in fragments(np.concatenate(ids), starts)), strict=True):
            pieces.setdefault(text, []).append({"period": q, "start": start, "end": end})
        joined = [b" ".join(words) for _, _, words in out]
        values = {
            "key": [x[0] for x in out], "doc_id": [x[1] for x in out], "n": [len(x[2]) for x in out], "sha": [hashlib.sha256(x).hexdigest() for x in joined],
            "pieces": [pieces.get(i, []) for i in range(len(out))], "words": [x if i in pieces else None for i, x in enumerate(joined)],
        }
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, words_held = [], 0
            for key, doc_id, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("key", "doc_id", "text")), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at \x20 and \x09-\x0D
                held.append((key.as_py(), doc_id.as_py(), words))
                words_held += len(words)
                if words_held > BLOCK:
                    yield block(held)
                    held, words_held = [], 0
            if held:
                yield block(held)

    return docs.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def stitched(pieces: DataFrame) -> DataFrame:
    """key, runs (an array of start, length, period in that order) from pieces (key, period, start, end): pieces of one period that share that many words are one run."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before >= F.col("start") + F.col("period"), 0).otherwise(1)
    marked = pieces.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period"))).alias("runs"))


def found_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """A row a document: key, doc_id, n, sha, words (null without runs) and runs, an array of (start, length, period), null without any."""
    rows = written(solved(keyed(docs).rows, rewrite), "pieces")
    pieces = rows.select("key", F.explode("pieces").alias("x")).select("key", "x.period", "x.start", "x.end")
    return rows.drop("pieces").join(stitched(pieces), "key", "left")


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space without those that any run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_texts(docs: DataFrame) -> DataFrame:
    """doc_id, runs and text: the words that are kept, joined by a space, of documents that have runs; the others' text needs no change and is null here."""

    def each(batch: pa.RecordBatch) -> dict:
        rows = batch.to_pylist()
        runs = [[(x["start"], x["length"], x["period"]) for x in r["runs"]] for r in rows]
        return {"doc_id": [r["doc_id"] for r in rows], "runs": [r["runs"] for r in rows], "text": [collapsed(r["words"].split(b" "), x).decode() for r, x in zip(rows, runs, strict=True)]}

    found = found_runs(docs).filter("runs is not null")
    return map_batches(found, T.StructType([found.schema["doc_id"], found.schema["runs"], T.StructField("text", T.StringType())]), each)


def periodic_rows(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """A row a document: doc_id, n_words, n_runs, the most repeated run, and digests of all runs and of the words that are kept.

    rewrite(doc_id, n): (a, p) lets words from a on repeat the p words from a; None leaves a text as it is.
    """
    schema = columns(doc_id="long", n_words="long", n_runs="long", start="long", length="long", period="long", exponent_milli="long", runs_sha256="str", collapsed_sha256="str")
    nothing = hashlib.sha256(b"").hexdigest()

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in schema}
        for r in batch.to_pylist():
            runs = [(x["start"], x["length"], x["period"]) for x in r["runs"] or []]
            best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
            values = (
                r["doc_id"], r["n"], len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest() if runs else nothing,
                hashlib.sha256(collapsed(r["words"].split(b" "), runs)).hexdigest() if runs else r["sha"],
            )
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return out

    return map_batches(found_runs(docs, rewrite), schema, each)
