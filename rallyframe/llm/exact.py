"""Exact deduplication by deterministic block naming, in DataFrame functions only.

The text without white space is cut into blocks of a fixed size. Distinct blocks are
sorted and numbered; the numbers name them. Then neighbouring names are paired, the
distinct pairs are sorted and numbered in turn, and so on until each document has one
name. Equal texts have equal names at every level and different texts of equal block
count differ at some level, so (block count, last name) is an identity without collisions.

Nulls: a null text counts as empty; empty texts equal each other. Repeated rows are
copies of each other; among rows that tie in length and doc_id one stays (null doc_ids
come last). Extra columns are ignored by ``exact_rows``.

Plan: each level is one distinct (equal blocks meet first inside each task, so a group
of copies with a third of all rows sends one row a task) and one join back, which Spark
may split where a name is hot. Names are (partition, place) numbers: no global sort in one
task. A level is written to the shared folder, so plans stay short; there are
log2(blocks of the longest text) levels of small integer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_they_came, keyed, whole_text, written

#: The deleted characters and the size of a block in characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"
BLOCK = 4096


def normalised(column: str = "text"):
    return F.translate(whole_text(column), SPACE_CHARS, "")


def _named(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """rows with ``name``: one number for each distinct ``by``, in sorted order in each partition."""
    names = rows.select(*by).distinct().sortWithinPartitions(*by)
    names = written(names.select(*by, F.monotonically_increasing_id().alias("name")), label)
    return rows.join(names, by)


def _blocks_named(blocks: DataFrame, key: str) -> DataFrame:
    """key, n_blocks, i, name: blocks named in sorted order.

    Only distinct blocks are shuffled; their names go back by two 64-bit hashes. That is exact
    because the hashes are checked to differ for the blocks at hand; where two
    blocks share both, names go back by the blocks themselves.
    """
    hashes = (F.xxhash64("block").alias("h"), F.xxhash64("block", F.lit(1)).alias("h2"))
    distinct = blocks.select("block").distinct().sortWithinPartitions("block")
    names = written(distinct.select(*hashes, F.monotonically_increasing_id().alias("name")), "blocks")
    if not names.groupBy("h", "h2").count().filter("count > 1").isEmpty():
        return _named(blocks, ["block"], "blocks").select(key, "n_blocks", "i", "name")
    return blocks.select(key, "n_blocks", "i", *hashes).join(names, ["h", "h2"]).select(key, "n_blocks", "i", "name")


def block_names(docs: DataFrame, key: str = "key", block: int = BLOCK) -> DataFrame:
    """key, n_blocks, name: the identity of each text. key must be unique."""
    text = docs.select(key, normalised().alias("t"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("t") / block)).cast("int")
    starts = F.sequence(F.lit(0), n_blocks - 1)
    cut = text.select(key, n_blocks.alias("n_blocks"), F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), F.substring("t", i * block + 1, F.lit(block)).alias("block")))).alias("b"))
    level = _blocks_named(cut.select(key, "n_blocks", "b.i", "b.block"), key)
    done, level = [], written(level, "names")
    widest = level.agg(F.max("n_blocks")).first()[0] or 1
    while True:
        done.append(level.filter("i = 0").select(key, "n_blocks", "name") if widest == 1 else level.filter(f"n_blocks <= 1 and {len(done)} = 0").select(key, "n_blocks", "name"))
        if widest == 1:
            break
        pairs = (
            level.filter("n_blocks > 1")
            .groupBy(key, "n_blocks", F.expr("i div 2").cast("int").alias("i"))
            .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
        )
        level = written(_named(pairs, ["l", "r"], "pairs").select(key, "n_blocks", "i", "name"), "names")
        widest = (widest + 1) // 2
    return done[0] if len(done) == 1 else done[0].unionByName(done[-1])


def exact_groups(rows: DataFrame) -> DataFrame:
    """key, doc_id, keep_id, group_size, kept, text_sha256: one row a document of rows (key, doc_id, text)."""
    meta = rows.select("key", "doc_id", F.length("text").alias("n"), F.sha2(normalised().cast("binary"), 256).alias("text_sha256"))
    named = written(meta.join(block_names(rows), "key"), "named")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    groups = written(named.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    one = named.join(groups, ["n_blocks", "name"])
    return one.select("key", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.key") == F.col("key")).alias("kept"), "text_sha256")


def exact_rows(docs: DataFrame) -> DataFrame:
    return exact_groups(keyed(docs).rows).drop("key")


def exact_filter(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns as they came."""
    rows = keyed(docs).rows
    kept = exact_groups(rows).filter("kept").select("key")
    return as_they_came(rows.join(kept, "key", "left_semi"), docs)
