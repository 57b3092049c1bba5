"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets counts over its whole text and a set of rule failures. Failures are
then counted by host (the document's ``source``), each host's rate is shrunk towards the
corpus by a beta prior fitted to the hosts themselves (method of moments), and the host's
verdict is joined back: on a host that fails more often than not, a document that breaks
any soft rule goes as well; elsewhere only the base rules remove documents.

Nulls: a null text has no words and fails the base rules; a null host is a host of its
own. Repeated rows count as often as they occur. Columns beyond doc_id, text and source
are not read by ``quality_rows``.

Plan: counts are narrow and computed once (a written table of numbers, no texts); the
only shuffle is one row a host and task, so a host with a third of all rows is no hot key.
Verdicts are joined back as a table of hosts; Spark's own size check decides on a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import whole_text, written

#: Fixed values of the rules: white space between words, symbols, and limits.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Soft rules, which only decide together with a host's verdict.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINES_PER_100_WORDS = 5
MIN_MEAN_WORD, MAX_MEAN_WORD = 2.0, 15.0
BAD_HOST_RATE = 0.5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more.

    Windows are hashed, sorted with their places, and compared with their neighbours;
    covered words are counted from the sorted places of the repeated ones. All steps are
    n log n in a document's words, and only documents with a repeat take the second part.
    """
    spots = F.sequence(F.lit(1), (n - (WINDOW - 1)).cast("int"))
    window = lambda i: F.xxhash64(*[F.get(hashes, i + (k - 1)) for k in range(WINDOW)])
    return F.when(n < WINDOW + 1, F.array().cast("array<bigint>")).otherwise(F.transform(spots, window))


def quality_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select(*keep, whole_text().alias("text"))
    words = rows.select(
        *keep,
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"),
        F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"),
    )
    sized = words.select(
        *keep, "n_symbols", "word_chars", "hashes",
        F.size("hashes").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    windows = sized.withColumn("windows", _repeat_words(F.col("hashes"), F.col("n_words"))).drop("hashes")
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    pairs = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    found = windows.withColumn("pairs", F.when(repeats, pairs))
    same = lambda a, b: F.coalesce(F.get("pairs", a)["h"] == F.get("pairs", b)["h"], F.lit(False))
    marked = F.transform("pairs", lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
    at = found.withColumn("at", F.sort_array(F.filter(marked, lambda x: x.isNotNull()))).drop("pairs", "windows")
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    counts = at.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def soft_failed() -> Column:
    n = F.col("n_words")
    return (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n)
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PER_100_WORDS * n)
        | (F.col("word_chars") < MIN_MEAN_WORD * n)
        | (F.col("word_chars") > MAX_MEAN_WORD * n)
    )


def host_verdicts(counts: DataFrame, host: str = "source") -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, bad_host; counts has ``failed`` as a boolean.

    The prior is the beta distribution with the hosts' mean rate and the part of their
    variance that binomial noise does not explain. Without such a part (or with a single
    host) the prior is as strong as 1000 documents at the mean rate.
    """
    hosts = counts.groupBy(host).agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"),
        F.avg(1 / F.col("n_docs")).alias("noise"),
    )
    between = F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("noise")
    strength = F.when(between > 0, F.col("m") * (1 - F.col("m")) / between - 1).otherwise(1000.0)
    prior = moments.select("m", F.greatest(F.lit(1.0), F.least(F.lit(1000.0), strength)).alias("s")).first()  # one row
    m, s = prior["m"] or 0.0, prior["s"] or 1.0
    return (
        hosts.withColumn("shrunk_rate", (F.col("n_failed") + m * s) / (F.col("n_docs") + s))
        .withColumn("bad_host", F.col("shrunk_rate") > BAD_HOST_RATE)
        .select(host, "n_docs", "n_failed", "shrunk_rate", "bad_host")
    )


def judged(counts: DataFrame, host: str = "source") -> DataFrame:
    """counts with soft_failed, shrunk_rate, bad_host and kept."""
    counts = counts.withColumn("soft_failed", soft_failed())
    counts = counts.withColumn("failed", F.col("base_failed") | F.col("soft_failed"))
    verdicts = host_verdicts(counts, host).select(F.col(host).alias("_host"), "shrunk_rate", "bad_host")
    joined = counts.join(verdicts, F.col(host).eqNullSafe(F.col("_host"))).drop("_host", "failed")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("bad_host") & F.col("soft_failed")))


def quality_rows(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, counts, base_failed, kept, and the host's figures."""
    return judged(written(quality_counts(docs), "quality"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns as they came.

    The columns travel in one struct beside the counts, so that no name can clash.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text", "source")
    kept = judged(written(quality_counts(rows, ("_row", "source")), "quality")).filter("kept")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
