"""Near-duplicate classes by DartMinHash signatures and banding.

A document is the multiset of its five-word shingles; a shingle's weight is its count. Each
unit of weight receives darts: a rank process of rate one, whose arrivals and coordinates
come from hashes of (shingle, unit, dart). A document keeps the darts of rank under t / weight
and takes the earliest of each coordinate; two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Where a coordinate is still empty, the
rank bound is doubled. A signature costs one hash a unit of weight and about
COORDINATES log COORDINATES darts, whatever the length.

Bands of ROWS coordinates make candidates. Texts with equal words form one class first and
go on as one representative. In each bucket every member is paired with the bucket's
most central member (the one with the most company over all its buckets), pairs are
verified on their shingles, and links are joined into components. Where a bucket then
still holds several components, members outside the largest are compared with all others,
in blocks: those that can reach the threshold by size and by their rarest units are verified
there, the likeliest by their signatures first. So copies of one text cost one pair each, and links beside the centres are found too.

Joins that move texts or units are merge joins at every size, so a plan that fits small tables is the plan for large ones.

Results: one row a document with class_id (the smallest key of the class; the doc_id where
doc_ids are unique), class_size, n_links (verified links of its representative) and kept.
Nulls: a null text counts as empty. Texts without words have no shingles and form one
class only with themselves; texts of one to four words are one shingle. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, as_they_came, columns, keyed, map_batches, texts_of, to_arrow, written

WORDS = 5
SIMILARITY = 0.8
COORDINATES, ROWS = 100, 4
BANDS = COORDINATES // ROWS
#: Expected darts: with t = k ln k + 2 k an empty coordinate has a chance of about exp(-2) / k each.
DARTS = COORDINATES * np.log(COORDINATES) + 2 * COORDINATES
CHUNK_BYTES = 1 << 21

#: A group of the comparison in blocks holds about 2 * BLOCK rows and 2 * BLOCK_BYTES bytes of units at most (its index takes some six times that), or one very long text.
BLOCK, BLOCK_BYTES = 4096, 1 << 26

SIGNED = columns(key="long", same="bytes", bands=T.ArrayType(T.LongType()), brief="bytes")
U = np.uint64
MIX = [U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of each value."""
    x = (x ^ (x >> U(30))) * MIX[1]
    x = (x ^ (x >> U(27))) * MIX[2]
    return x ^ (x >> U(31))


#: Whether a byte is one of the six white space characters, and a fixed random number for each byte.
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * MIX[0])
STEP = int(MIX[3]) | 1
BACK = pow(STEP, -1, 1 << 64)


def powers(x: int, n: int) -> np.ndarray:
    """x ** 0 .. x ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, U(x))
    out[0] = 1
    return np.cumprod(out)


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word of the texts, in order; words are runs without white space.

    A word's hash is a difference of running sums of byte numbers times powers, moved back to its start.
    """
    data = np.frombuffer(b" ".join([*raws, b""]), dtype=np.uint8)
    word = ~IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([[U(0)], np.cumsum(OF_BYTE[data] * powers(STEP, max(1, len(data)))[: len(data)])])
    h = (total[end] - total[start]) * powers(BACK, max(1, len(data)))[start]
    begins = np.cumsum([0] + [len(x) + 1 for x in raws[:-1]])
    return np.searchsorted(begins, start, side="right") - 1, mixed(h + (end - start).astype(np.uint64) * MIX[2])


def shingles(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of every shingle of the texts, documents ascending."""
    doc, h = word_hashes(raws)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    counts = np.bincount(doc, minlength=len(raws))
    left = np.cumsum(counts)[doc] - np.arange(n)  # words from here to the document's end
    combined = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(WORDS, dtype=np.uint64)])
    for i in range(WORDS):
        word = np.where(left > i, padded[i : i + n], U(0))
        combined = mixed(combined * MIX[0] + word + U(i + 1))
    use = (left >= WORDS) | ((counts[doc] < WORDS) & (left == counts[doc]))
    return doc[use], combined[use]


def weighted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, unit of weight) sorted: each repetition of a shingle in a document is a unit of its own."""
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])])
    begin = np.flatnonzero(new)
    layer = np.arange(len(doc)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(doc)]])))
    return doc, mixed(shingle + MIX[0] * layer.astype(np.uint64))


def signatures(doc: np.ndarray, unit: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document and coordinate the id of the earliest dart, 0 where a document has no unit."""
    weight = np.bincount(doc, minlength=n_docs)
    rank = np.full(n_docs * COORDINATES, np.inf)
    dart = np.zeros(n_docs * COORDINATES, dtype=np.uint64)
    bound = DARTS / np.maximum(weight, 1)
    open_docs = weight > 0
    while open_docs.any():
        use = open_docs[doc]
        d, u, arrival, throw = doc[use], unit[use], np.zeros(use.sum()), 0
        limit = bound[d]
        while len(d):
            throw += 1
            x = mixed(u + U((int(MIX[3]) * throw) & (2**64 - 1)))
            arrival = arrival - np.log(((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53)
            near = arrival <= limit
            d, u, arrival, limit, x = d[near], u[near], arrival[near], limit[near], x[near]
            if not len(d):
                break
            y = mixed(x + MIX[0])
            slot = d * COORDINATES + (y % U(COORDINATES)).astype(np.int64)
            order = np.lexsort((y, arrival, slot))
            first = order[np.concatenate([[True], np.diff(slot[order]) != 0])]
            s, r = slot[first], arrival[first]
            better = r < rank[s]
            rank[s[better]], dart[s[better]] = r[better], y[first][better]
        empty = np.isinf(rank.reshape(n_docs, COORDINATES)).any(axis=1)
        open_docs &= empty
        bound[open_docs] *= 2
        again = np.flatnonzero(open_docs)
        rank.reshape(n_docs, COORDINATES)[again] = np.inf
    return dart.reshape(n_docs, COORDINATES)


def in_chunks(raws: list[bytes]):
    """Ranges of texts with about CHUNK_BYTES bytes."""
    at, size = 0, 0
    for i, raw in enumerate(raws):
        size += len(raw) + 1
        if size > CHUNK_BYTES or i == len(raws) - 1:
            yield at, i + 1
            at, size = i + 1, 0


def signed(rows: DataFrame) -> DataFrame:
    """SIGNED: for each text a digest of its words, null where it has none, and its band hashes."""

    def each(batch: pa.RecordBatch) -> dict:
        raws = [x.encode() for x in texts_of(batch)]
        same, bands, brief = [], [], []
        for a, b in in_chunks(raws):
            doc, shingle = shingles(raws[a:b])
            doc, unit = weighted(doc, shingle)
            darts = signatures(doc, unit, b - a)
            table = darts.reshape(b - a, BANDS, ROWS)
            has = np.bincount(doc, minlength=b - a) > 0
            band = np.zeros((b - a, BANDS), dtype=np.uint64)
            for i in range(ROWS):
                band = mixed(band * MIX[0] + table[:, :, i])
            band = mixed(band + np.arange(BANDS, dtype=np.uint64) * MIX[3]).view(np.int64)
            bands += [x if h else None for x, h in zip(band.tolist(), has.tolist(), strict=True)]
            brief += [x.tobytes() if h else None for x, h in zip((darts >> U(48)).astype(np.uint16), has.tolist(), strict=True)]
            same += [hashlib.blake2b(b" ".join(x.split()), digest_size=16).digest() if h else None for x, h in zip(raws[a:b], has.tolist(), strict=True)]
        return {"key": batch.column(0), "same": same, "bands": bands, "brief": brief}

    return map_batches(rows.select("key", "text"), SIGNED, each)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of distinct units."""
    short, long = sorted((len(x), len(y)))
    if not short:
        return 0.0
    if short < SIMILARITY * long:
        return short / long  # it can't be more
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def units_of(raws: list[bytes]) -> list[np.ndarray]:
    """The sorted units of each text."""
    doc, unit = weighted(*shingles(raws)) if any(raws) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.lexsort((unit, doc))
    cuts = np.searchsorted(doc[order], np.arange(len(raws) + 1))
    unit = unit[order]
    return [unit[cuts[i] : cuts[i + 1]] for i in range(len(raws))]


def all_units(rows: DataFrame) -> DataFrame:
    """key, units of rows (key, text)."""

    def each(batch: pa.RecordBatch) -> dict:
        raws = [x.encode() for x in texts_of(batch)]
        return {"key": batch.column(0), "units": [x.tobytes() for a, b in in_chunks(raws) for x in units_of(raws[a:b])]}

    return map_batches(rows.select("key", "text"), columns(key="long", units="bytes"), each)


def verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """a, b of the pairs whose texts have a similarity of SIMILARITY or more."""

    def each(batch: pa.RecordBatch) -> dict:
        arrays = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
        return {"a": batch.column(0), "b": batch.column(1), "close": [similarity(x, y) >= SIMILARITY for x, y in zip(*arrays, strict=True)]}

    left = pairs.join(units.select(F.col("key").alias("a"), F.col("units").alias("x")).hint("merge"), "a")
    both = left.join(units.select(F.col("key").alias("b"), F.col("units").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
    return map_batches(both, columns(a="long", b="long", close="bool"), each).filter("close").select("a", "b")


def checksum(edges: DataFrame) -> tuple:
    """Count and two combinations of 64-bit hashes of distinct edges: one aggregation tells whether a round changed them."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """key, label: the smallest key of each component of links (a, b); by alternating star contraction.

    Each round points every key to the smallest key near it; a round halves the depth of
    trees, so rounds are few. Each is written to the shared folder.
    """
    edges = scratch.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = checksum(edges)
    while True:
        # large star: larger neighbours go to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: smaller neighbours and the key itself go to the smallest of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = scratch.written(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark, old, edges = mark, checksum(now), edges, now
        scratch.drop(old)
        if mark == before:
            return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "key")


def near_classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """key, class_key, n_links for rows (key, text).

    What a join needs of an aggregation is written before, so that Spark may split a hot key of the join.
    """
    marks = scratch.written(signed(rows), "signed")
    heads = scratch.written(marks.filter("same is not null").groupBy("same").agg(F.min("key").alias("head")), "heads")
    member = marks.select("key", "same").join(heads, "same", "left").select("key", F.coalesce("head", "key").alias("head"))
    first = marks.join(heads.select(F.col("head").alias("key")), "key", "left_semi")
    buckets = first.select("key", F.explode("bands").alias("bucket"))
    full = scratch.written(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "full")
    buckets = scratch.written(buckets.join(full, "bucket"), "buckets")
    units = scratch.written(all_units(rows.join(buckets.select("key").distinct().hint("merge"), "key", "left_semi")), "units")
    score = buckets.groupBy("key").agg(F.sum("n").alias("score"))
    ranked = buckets.join(score, "key")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("key")).alias("key")))["key"].alias("centre"))
    centres = scratch.written(centres.select("bucket", (-F.col("centre")).alias("centre")), "centres")
    pairs = buckets.join(centres, "bucket").filter("key <> centre")
    links = scratch.written(verified(pairs.select(F.col("key").alias("a"), F.col("centre").alias("b")).distinct(), units), "links")
    labels = scratch.written(components(links, scratch), "labels")
    links = scratch.written(links.unionByName(between_components(buckets, labels, first, units, scratch)), "links")
    labels = scratch.written(components(links, scratch), "labels")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy("a").agg(F.count("*").alias("n_links"))
    ends = scratch.written(ends, "ends")
    found = member.join(labels.withColumnRenamed("key", "head"), "head", "left").join(ends.withColumnRenamed("a", "head"), "head", "left")
    return found.select("key", F.coalesce("label", "head").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


class Postings:
    """The holders of each unit among some sorted arrays of units.

    Arrays of SIMILARITY share at least that part of either's units. So of any units of one that are more than
    the rest, the other has one: the rarest are looked up.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        units = np.concatenate(sets)
        order = np.argsort(units, kind="stable")
        units = units[order]
        new = np.concatenate([[True], units[1:] != units[:-1]])
        self.code = np.empty(len(units), np.int32)  # for each unit of each array its place among distinct units
        self.code[order] = np.cumsum(new, dtype=np.int32) - 1
        self.at = np.flatnonzero(new)
        self.count = np.diff(np.concatenate([self.at, [len(units)]]))
        self.holder = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]

    def within_reach(self, i: int) -> np.ndarray:
        """The arrays, i among them, that may have a similarity of SIMILARITY or more to i."""
        mine, size = self.code[self.begin[i] : self.begin[i + 1]], int(self.sizes[i])
        least = int(np.ceil(SIMILARITY * size - 1e-6))
        rare = mine[np.argsort(self.count[mine], kind="stable")[: size - least + 1]]
        n = self.count[rare]
        spots = np.repeat(self.at[rare] - np.cumsum(n) + n, n) + np.arange(n.sum())
        met = np.unique(self.holder[spots])
        small, large = np.minimum(self.sizes[met], size), np.maximum(self.sizes[met], size)
        return met[small >= SIMILARITY * large]


def dealt_members(buckets: DataFrame, labels: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    """key, label, foreign, g: the members of buckets with several components, dealt to groups g so that all pairs that need a comparison meet in one.

    In each bucket the foreign members, those outside its largest component, are compared with all members, both in
    blocks of BLOCK rows, or of BLOCK_BYTES where texts are long: a bucket of n members, f of them foreign, costs about n * ceil(f / BLOCK) + f * ceil(n / BLOCK) rows, n where all but a
    few are in one component.
    """
    known = buckets.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = known.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n_all"))
    largest = scratch.written(largest.filter("n_all > top.c").select("bucket", F.col("top.label").alias("main"), (F.col("n_all") - F.col("top.c")).alias("f")), "largest")
    mixed_ = known.join(largest, "bucket").join(units.select("key", F.octet_length("units").cast("long").alias("w")), "key")
    mixed_ = scratch.written(mixed_, "members")
    wide = mixed_.groupBy("bucket").agg(F.sum("w").alias("n_w"), F.coalesce(F.sum(F.when(F.col("label") != F.col("main"), F.col("w"))), F.lit(0)).alias("f_w"))
    several = scratch.written(mixed_.join(scratch.written(wide, "widths"), "bucket"), "mixed")
    scratch.drop(mixed_)
    blocks = lambda c: F.ceil(F.greatest(F.col(c) / BLOCK, F.col(f"{c}_w") / BLOCK_BYTES, F.lit(1.0))).cast("int")
    row, column = (F.pmod(F.xxhash64("key", F.lit(i)), blocks(c)).cast("int") for i, c in enumerate(("n", "f")))
    any_ = several.select("bucket", "key", "label", F.lit(False).alias("foreign"), row.alias("i"), F.explode(F.sequence(F.lit(0), blocks("f") - 1)).alias("j"))
    foreign = several.filter("label <> main").select("bucket", "key", "label", F.lit(True).alias("foreign"), F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("i"), column.alias("j"))
    return any_.unionByName(foreign).select("key", "label", "foreign", F.xxhash64("bucket", "i", "j").alias("g"))


def between_components(buckets: DataFrame, labels: DataFrame, first: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links between members of a bucket that are in different components.

    A group of dealt_members compares only what Postings does not exclude,
    those first whose signatures agree most; a link joins two components, which then need no other.
    """
    dealt = dealt_members(buckets, labels, units, scratch)
    dealt = dealt.join(first.select("key", "brief").join(units.hint("merge"), "key").hint("merge"), "key")

    def compared(rows: list[list]) -> list[tuple[int, int]]:
        keys, labels_, foreign, briefs, raw = rows
        code = np.unique(np.array(labels_), return_inverse=True)[1]
        if code.max() == 0:
            return []
        table = np.frombuffer(b"".join(briefs), np.uint16).reshape(len(keys), COORDINATES)
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        postings = Postings(sets)
        out = []
        for i in np.flatnonzero(np.array(foreign)).tolist():
            near = postings.within_reach(i)
            near = near[code[near] != code[i]]
            agree = (table[near] == table[i]).sum(axis=1)
            for j in near[np.argsort(-agree, kind="stable")].tolist():
                if code[i] != code[j] and similarity(sets[i], sets[j]) >= SIMILARITY:
                    out.append((max(keys[i], keys[j]), min(keys[i], keys[j])))
                    code[code == code[j]] = code[i]
        return out

    schema = columns(a="long", b="long")
    arrow = to_arrow(schema)

    def run(batches):
        held: list[list] = [[] for _ in range(5)]
        group = None

        def out(rows):
            pairs = list(dict.fromkeys(compared(rows)))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], schema=arrow)

        for batch in batches:
            g = batch.column(0).to_pylist()
            own = [batch.column(i).to_pylist() for i in range(1, 6)]
            begin = 0
            for i in range(len(g) + 1):
                if i == len(g) or g[i] != group:
                    for h, x in zip(held, own, strict=True):
                        h += x[begin:i]
                    begin = i
                    if i < len(g):
                        if held[0]:
                            yield out(held)
                        held, group = [[] for _ in range(5)], g[i]
        if held[0]:
            yield out(held)

    met = dealt.select("g", "key", "label", "foreign", "brief", "units").repartition("g").sortWithinPartitions("g", "key")
    return met.mapInArrow(run, schema).distinct()


def near_groups(rows: DataFrame) -> DataFrame:
    """key, doc_id, class_id, class_size, n_links, kept: one row a document of rows; the smallest key of a class is kept."""
    with Scratch(rows.sparkSession) as scratch:
        classes = written(near_classes(rows.select("key", "text"), scratch), "classes")
    sizes = written(classes.groupBy("class_key").agg(F.count("*").alias("class_size")), "sizes")
    ids = rows.select("key", "doc_id")
    heads = sizes.join(ids.select(F.col("key").alias("class_key"), F.col("doc_id").alias("class_id")), "class_key")
    found = classes.join(written(heads, "heads"), "class_key").join(ids, "key")
    return found.select("key", "doc_id", "class_id", "class_size", "n_links", (F.col("key") == F.col("class_key")).alias("kept"))


def near_rows(docs: DataFrame) -> DataFrame:
    return near_groups(keyed(docs).rows).drop("key")


def near_filter(docs: DataFrame) -> DataFrame:
    """One document of each class, with its columns as they came."""
    rows = keyed(docs).rows
    kept = near_groups(rows).filter("kept").select("key")
    return as_they_came(rows.join(kept, "key", "left_semi"), docs)
