"""Removal of repeated 100-byte strings with a sparse suffix array, deep-shallow sorted.

A byte goes if a 100-byte string that covers it also starts earlier: in a document with a
smaller doc_id, or earlier in the same one. Strings are judged on the input.

Every 100-byte window has one anchor: the place in it of the smallest hash of SEED bytes
(the leftmost of equals). Equal windows have equal anchors, so only suffixes at anchors are
sorted, about one in forty, and only where an anchor's SEED bytes occur twice. A row is
a run of windows with one anchor and the bytes they cover. Rows meet by anchor; in each
group the suffixes from the anchor on, and the reversed prefixes before it, are sorted:
multikey quicksort to SHALLOW bytes (eight bytes are one key), then a blind trie for each group
that still ties. The common prefix lengths of neighbours in the two orders then say, for every
window place, which rows have the same window; of each such class the earliest stays.

Nulls: a null text counts as empty. Rows that share a doc_id, or have none, are
ordered by text (nulls first), see ``shared.keyed``. Texts under 100 bytes stay whole.

Plan: anchors are found where texts are read and travel as (hash, key), once a batch and
hash. Texts move once, by key, and that exchange serves both the second look at the texts and
the last join. Equal rows of a batch meet before they are sent, so a group of copies sends one
row a batch; an anchor that occurs more than HOT times is dealt out by the 93 bytes that eight
neighbouring windows share, one that occurs more than SINGLE times by single windows. Tasks
stream groups in key order and hold the different rows of one: at most SINGLE, or one where windows
are single. Nothing goes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns, keyed, map_batches, texts_of, to_arrow

LENGTH = 100
SEED = 24
SHALLOW = 40
HOT, NEIGHBOURS = 20_000, 8
SINGLE = 500_000
CHUNK = 1 << 21
BLOCK_ROWS = 200_000
PLACES = LENGTH - SEED + 1

SEEDS = columns(h="long", key="long", more=T.ArrayType(T.LongType()))
ROWS = columns(g="long", key="long", at="long", lead="int", size="int", content="bytes")
SPANS = columns(key="long", s="long", e="long")
RESULT = columns(doc_id="long", n_bytes="long", n_removed="long", n_spans="long", kept_sha256="str")

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each place on."""
    word = data.astype(np.uint64)
    for step in (1, 2, 4):
        word = word[:-step] | (word[step:] << np.uint64(8 * step))
    n = len(data) - SEED + 1
    h = word[:n] * MIX[0]
    h ^= h >> np.uint64(31)
    h += word[8 : 8 + n] * MIX[1]
    h ^= h >> np.uint64(29)
    h += word[16 : 16 + n] * MIX[2]
    h ^= h >> np.uint64(32)
    h *= MIX[3]
    h ^= h >> np.uint64(29)
    return h


def anchor_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, hash) of each run of windows of data.

    starts and ends are the documents' places in data; results are places in data too.
    """
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < LENGTH:
        return empty
    h = seed_hashes(data)
    mask = np.uint64((1 << 24) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < PLACES:
        key = np.minimum(key[: len(key) - (PLACES - width)], key[PLACES - width :])
    long = ends - starts >= LENGTH
    step = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(step[: len(key)]))
    if not len(window):
        return empty
    anchor = (key[window] & mask).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(window)]]) - 1
    a, b, p = window[first], window[last], anchor[first]
    return np.searchsorted(starts, a, side="right") - 1, a, b, p, h[p]


def chunks(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, document, place of the piece in its document, start, end) of up to CHUNK bytes.

    Longer documents come in pieces that overlap by a window, so that each window is in one piece.
    """
    pieces: list[tuple[int, int, bytes]] = []
    size = 0
    for i, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
            piece = raw[at : at + CHUNK + LENGTH - 1] if len(raw) > CHUNK else raw
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > CHUNK and pieces:
                yield _joined(pieces)
                pieces, size = [], 0
            pieces.append((i, at, piece))
            size += len(piece)
            if len(raw) <= CHUNK:
                break
    if pieces:
        yield _joined(pieces)


def _joined(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    ends = np.cumsum([len(x[2]) for x in pieces])
    starts = np.concatenate([[0], ends[:-1]])
    doc, at = np.array([x[0] for x in pieces]), np.array([x[1] for x in pieces])
    return np.frombuffer(b"".join(x[2] for x in pieces), np.uint8), doc, at, starts, ends


def seeds(rows: DataFrame) -> DataFrame:
    """SEEDS: a row for each anchor hash and batch; more is null if it occurs once, else the number of occurrences and then further keys."""

    def each(batch: pa.RecordBatch) -> dict:
        keys = np.array(batch.column(0).to_pylist(), dtype=np.int64)
        hs, owners = [], []
        for data, doc, _, starts, ends in chunks([x.encode() for x in texts_of(batch)]):
            d, _, _, _, h = anchor_runs(data, starts, ends)
            hs.append(h)
            owners.append(keys[doc[d]])
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        key = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        h, key = h[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([first, [len(h)]]))
        offsets, values = np.zeros(len(first) + 1, dtype=np.int64), []
        for i in np.flatnonzero(counts > 1).tolist():
            own = np.unique(key[first[i] : first[i] + counts[i]])
            own = np.concatenate([counts[i : i + 1], own[own != key[first[i]]]])
            offsets[i + 1] = len(own)
            values.append(own)
        offsets = np.cumsum(offsets)
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        more = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()), mask=pa.array(counts == 1))
        return {"h": h[first].view(np.int64), "key": key[first], "more": more.cast(pa.list_(pa.field("element", pa.int64())))}

    return map_batches(rows.select("key", "text"), SEEDS, each)


def repeated(found: DataFrame) -> DataFrame:
    """key, hs, hot, single: each document's anchor hashes that occur twice, those more than HOT times, and those more than SINGLE times."""
    n = F.sum(F.when(F.col("more").isNull(), 1).otherwise(F.get("more", 0))).over(Window.partitionBy("h"))
    twice = found.withColumn("n", n).filter("n > 1")
    keys = F.when(F.col("more").isNull(), F.array("key")).otherwise(F.concat(F.array("key"), F.slice("more", 2, F.greatest(F.size("more") - 1, F.lit(0)))))
    each = twice.select("h", "n", F.explode(keys).alias("key"))
    beyond = lambda most: F.collect_list(F.when(F.col("n") > most, F.col("h")))
    return each.groupBy("key").agg(F.collect_list("h").alias("hs"), beyond(HOT).alias("hot"), beyond(SINGLE).alias("single"))


def _hash_bytes(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def anchor_rows(rows: DataFrame) -> DataFrame:
    """ROWS of the documents of rows (key, _row, hs, hot, single), whose texts are _row.text; a row without content is a span that goes, and is dealt by key."""

    def each(batch: pa.RecordBatch) -> dict:
        keys = batch.column(0).to_pylist()
        wanted = np.unique(np.array([h for hs in batch.column(2).to_pylist() for h in hs or ()], dtype=np.int64)).view(np.uint64)
        steps: dict[int, int] = {}
        for column, step in ((3, NEIGHBOURS), (4, 1)):
            steps.update({h & (1 << 64) - 1: step for hs in batch.column(column).to_pylist() for h in hs or ()})
        out: list[tuple] = []
        # places in doc_id order, so that the first of equal rows is the earliest
        by_key = sorted(range(len(keys)), key=keys.__getitem__)
        texts = row_texts(batch.column(1))
        met: set[tuple] = set()
        for data, doc, shift, starts, ends in chunks([texts[i].encode() for i in by_key]):
            d, a, b, p, h = anchor_runs(data, starts, ends)
            use = np.isin(h, wanted)
            raw = data.tobytes()
            for i, first, last, anchor, seed in zip(d[use].tolist(), a[use].tolist(), b[use].tolist(), p[use].tolist(), h[use].tolist(), strict=True):
                key, off = keys[by_key[doc[i]]], int(shift[i] - starts[i])
                parts, step = [(first, last)], steps.get(seed)
                if step:
                    parts = []
                    for j in range((anchor - last) // step, (anchor - first) // step + 1):
                        parts.append((max(first, anchor - step * j - step + 1), min(last, anchor - step * j)))
                for lo, hi in parts:
                    content = raw[lo : hi + LENGTH]
                    g = seed - (seed >> 63 << 64)
                    if step:
                        s = anchor - (anchor - lo) // step * step
                        g = _hash_bytes(raw[s : s + LENGTH - step + 1])
                    mark = (g, anchor - lo, content)
                    if mark in met:
                        out.append((key, key, lo + off, anchor - lo, len(content), None))
                    else:
                        met.add(mark)
                        out.append((g, key, lo + off, anchor - lo, len(content), content))
        return {f.name: [x[i] for x in out] for i, f in enumerate(ROWS)}

    return map_batches(rows.select("key", "_row", "hs", "hot", "single"), ROWS, each)


def row_texts(rows: pa.StructArray) -> list[str]:
    """The texts of a column of _row; null counts as empty."""
    return [x or "" for x in rows.field("text").to_pylist()]


class BlindTrie:
    """A Patricia tree over distinct strings: inner nodes hold a depth and branch by one byte."""

    def __init__(self, first: bytes):
        self.root: list | bytes = first

    @staticmethod
    def common(x: bytes, y: bytes) -> int:
        lo, hi = 0, min(len(x), len(y))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid - 1)
        return lo

    @staticmethod
    def at(x: bytes, depth: int) -> int:
        return x[depth] if depth < len(x) else -1

    def insert(self, x: bytes) -> None:
        node = self.root
        while isinstance(node, list):  # blindly: only branching bytes are compared
            node = node[1].get(self.at(x, node[0])) or next(iter(node[1].values()))
        depth = self.common(x, node)
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, node = node, node[1][self.at(x, node[0])]
        if isinstance(node, list) and node[0] == depth:
            node[1][self.at(x, depth)] = x
            return
        leaf = node
        while isinstance(leaf, list):
            leaf = next(iter(leaf[1].values()))
        new = [depth, {self.at(leaf, depth): node, self.at(x, depth): x}]
        if parent is None:
            self.root = new
        else:
            parent[1][self.at(x, parent[0])] = new

    def ordered(self) -> Iterator[tuple[bytes, int]]:
        """Strings in order, with the common prefix with the one before."""
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, list):
                children = sorted(node[1].items())
                stack += [(child, node[0] if i else lcp) for i, (_, child) in reversed(list(enumerate(children)))]
            else:
                yield node, lcp


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows of words (one key a column) within groups; rows with equal keys stay together.

    All segments are split at once, each by a pivot of its own at its own depth: smaller and greater
    rows go on at that depth, equal ones at the next.
    """
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    begin = np.concatenate([[0], cuts])
    size = np.diff(np.concatenate([begin, [len(order)]]))
    depth = np.zeros(len(begin), dtype=np.int64)
    while True:
        open_ = (size > 1) & (depth < words.shape[1])
        begin, size, depth = begin[open_], size[open_], depth[open_]
        if not len(begin):
            return order
        inside = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(begin)), size)
        spot = np.arange(len(segment)) + np.repeat(begin - inside, size)
        key = words[order[spot], depth[segment]]
        pivot = key[inside + size // 2][segment]
        side = 3 * segment + 1 + (key > pivot) - (key < pivot)
        order[spot] = order[spot][np.argsort(side, kind="stable")]
        parts = np.bincount(side, minlength=3 * len(begin))
        begin = np.repeat(begin - inside, 3) + np.cumsum(parts) - parts
        depth = np.repeat(depth, 3)
        depth[1::3] += 1
        size = parts


def common_bytes(words: np.ndarray) -> np.ndarray:
    """How many bytes each row of big-endian words shares with the row before; 0 for the first."""
    differ = words[1:] ^ words[:-1]
    other = differ != 0
    column = np.where(other.any(axis=1), other.argmax(axis=1), words.shape[1])
    last = np.minimum(column, words.shape[1] - 1)
    word = differ[np.arange(len(differ)), last]
    agree, alive = np.zeros(len(differ), dtype=np.int64), column < words.shape[1]
    for k in range(7):
        alive &= (word >> np.uint64(8 * (7 - k))) == 0
        agree += alive
    return np.concatenate([[0], 8 * column + agree])


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): strings sorted within groups; lcp with the one before, -1 between groups.

    Multikey quicksort orders the first SHALLOW bytes; then a blind trie orders each group of ties.
    """
    n = len(strings)
    sizes = np.array([len(x) for x in strings], dtype=np.int64)
    words = np.frombuffer(b"".join(x[:SHALLOW].ljust(SHALLOW, b"\0") for x in strings), dtype=">u8").reshape(n, SHALLOW // 8).astype(np.uint64)
    order = multikey_quicksort(words, group)
    lcp = common_bytes(words[order])
    lcp[np.concatenate([[True], np.diff(group[order]) != 0])] = -1
    tied = lcp >= SHALLOW
    begins = np.flatnonzero(tied & ~np.concatenate([[False], tied[:-1]]))
    stops = np.flatnonzero(tied & ~np.concatenate([tied[1:], [False]])) + 1
    for begin, stop in zip((begins - 1).tolist(), stops.tolist(), strict=True):
        rows = order[begin:stop].tolist()
        equal: dict[bytes, list[int]] = {}
        for r in rows:
            equal.setdefault(strings[r], []).append(r)
        distinct = iter(equal)
        trie = BlindTrie(next(distinct))
        for x in distinct:
            trie.insert(x)
        place = begin
        for x, common in trie.ordered():
            for i, r in enumerate(equal[x]):
                if place > begin:
                    lcp[place] = len(x) if i else common
                order[place] = r
                place += 1
    # padding is not part of a string
    before = np.concatenate([[0], order[:-1]])
    return order, np.minimum(lcp, np.minimum(sizes[order], sizes[before]))


def resolved(g: list[int], key: list[int], at: list[int], lead: list[int], content: list[bytes]) -> list[tuple[int, int, int]]:
    """SPANS that go, of whole groups of different rows in the order (g, key, at)."""
    spans = []
    groups = np.array(g, dtype=np.int64)
    cuts = np.flatnonzero(np.diff(groups)) + 1
    sizes = np.diff(np.concatenate([[0], cuts, [len(g)]]))
    rows = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    if not len(rows):
        return spans
    use, groups = rows.tolist(), groups[rows]
    leads = np.array([lead[i] for i in use], dtype=np.int64)
    lows = leads - np.array([len(content[i]) - LENGTH for i in use], dtype=np.int64)
    classes = []
    for strings in ([content[i][lead[i] :] for i in use], [content[i][: lead[i]][::-1] for i in use]):
        order, lcp = deep_shallow(strings, groups)
        rank = np.empty(len(use), dtype=np.int64)
        rank[order] = np.arange(len(use))
        classes.append((rank, lcp))
    (rank_r, lcp_r), (rank_l, lcp_l) = classes
    gone = np.zeros((len(use), PLACES + 2), dtype=bool)  # window place o is in column o + 1
    for o in range(PLACES):
        active = np.flatnonzero((lows <= o) & (leads >= o))
        if len(active) < 2:
            continue
        right = np.cumsum(lcp_r < LENGTH - o)[rank_r[active]]
        left = np.cumsum(lcp_l < o)[rank_l[active]]
        _, first = np.unique(right * (len(use) + 1) + left, return_index=True)
        later = np.ones(len(active), dtype=bool)
        later[first] = False
        gone[active[later], o + 1] = True
    change = np.diff(gone.astype(np.int8), axis=1)
    r, lo = np.nonzero(change == 1)
    _, hi = np.nonzero(change == -1)
    for i, low, high in zip(rows[r].tolist(), lo.tolist(), (hi - 1).tolist(), strict=True):
        anchor = at[i] + lead[i]
        spans.append((key[i], anchor - high, anchor - low + LENGTH))
    return spans


def spans_of(rows: DataFrame) -> DataFrame:
    """SPANS that go, from ROWS. Of a group only rows that differ are held; the others go at once, for an equal row came before."""
    schema = to_arrow(SPANS)

    def out(spans: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in spans], pa.int64()) for i in range(3)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, met = None, set()
        for batch in batches:
            known = pc.is_null(batch.column(5))
            done = batch.filter(known)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(1), done.column(2), pc.add(done.column(2), done.column(4).cast(pa.int64()))], schema=schema)
            batch = batch.filter(pc.invert(known))
            spans = []
            for row in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)], strict=True):
                if row[0] != group:
                    if len(held) >= BLOCK_ROWS:
                        spans += resolved(*map(list, zip(*held, strict=True)))
                        held = []
                    group, met = row[0], set()
                mark = row[3:]
                if mark in met:
                    spans.append((row[1], row[2], row[2] + len(row[4])))
                else:
                    met.add(mark)
                    held.append(row)
            if spans:
                yield out(spans)
        if held:
            yield out(resolved(*map(list, zip(*held, strict=True))))

    return rows.repartition("g").sortWithinPartitions("g", "key", "at").mapInArrow(run, SPANS)


def repeated_spans(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """_key, spans: what goes of each document that loses something; rows (key, _row) hold the texts (key, text) once more."""
    return spans_of(anchor_rows(rows.join(repeated(seeds(texts)), "key"))).groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in runs:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def with_spans(docs: DataFrame, *columns: str) -> DataFrame:
    """_row (a struct of columns of docs) and spans of every document; the one exchange of rows by key serves both joins."""
    rows = keyed(docs).rows.filter("key is not null")
    moving = rows.select("key", F.struct(*[F.col("_row")[c].alias(c) for c in columns]).alias("_row"))
    spans = repeated_spans(rows.select("key", "text"), moving)
    return moving.join(spans, F.col("key") == F.col("_key"), "left").select("_row", "spans")


def suffix_rows(docs: DataFrame) -> DataFrame:
    """RESULT: one row a document."""

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in RESULT}
        row = batch.column(0)
        for doc_id, text, spans in zip(row.field("doc_id").cast(pa.int64()).to_pylist(), row_texts(row), batch.column(1).to_pylist(), strict=True):
            raw, runs = text.encode(), merged(spans)
            values = (doc_id, len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(raw, runs)).hexdigest())
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return out

    return map_batches(with_spans(docs, "doc_id", "text"), RESULT, each)


def suffix_filter(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text, and n_chars, if there is one, counted anew.

    Bytes of a character that is cut in two are dropped. Documents with nothing left stay, with an
    empty text; rows without repeats stay as they came, a null text null.
    """
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = batch.column(0), batch.column(1).to_pylist()
            text, own = rows.field("text").to_pylist(), {f.name: rows.field(i) for i, f in enumerate(rows.type)}
            lengths = own["n_chars"].to_pylist() if counted else None
            for i, several in enumerate(spans):
                if several:
                    text[i] = without((text[i] or "").encode(), merged(several)).decode("utf-8", "ignore")
                    if counted:
                        lengths[i] = len(text[i])
            own["text"] = pa.array(text, own["text"].type)
            if counted:
                own["n_chars"] = pa.array(lengths, own["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    return with_spans(docs, *docs.columns).mapInArrow(run, docs.schema)
