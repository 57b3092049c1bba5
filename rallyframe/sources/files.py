"""Results files in and tables out."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.ordering import numbered

TEXT = "tourney_id tourney_name tourney_level surface indoor round winner_id loser_id winner_name loser_name winner_ioc loser_ioc winner_hand loser_hand winner_entry loser_entry score".split()
NUMBERS = "tourney_date draw_size best_of match_num winner_seed loser_seed winner_age loser_age winner_rank loser_rank winner_rank_points loser_rank_points winner_ht loser_ht minutes".split()
COUNTS = [f"{side}_{name}" for side in "wl" for name in "ace df svpt 1stIn 1stWon 2ndWon SvGms bpSaved bpFaced".split()]
#: Every column is read as text and cast with care, so that one bad cell costs one null.
RESULTS = T.StructType([T.StructField(c, T.StringType()) for c in [*TEXT, *NUMBERS, *COUNTS]])


def headers(spark: SparkSession, glob: str) -> dict[str, list[str]]:
    """The different first lines of CSV files, each with the files that begin with it."""
    lines = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "i").alias("header"))
    return {r["header"]: sorted(r["files"]) for r in first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()}


def by_name(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """CSV files united by the names of their columns: files of one header are read together, columns that a header lacks are null, others are not read. No files: no rows."""
    parts = []
    for header, paths in sorted(headers(spark, glob).items()):
        own = T.StructType([T.StructField(c.strip(), T.StringType()) for c in next(csv.reader([header.removeprefix("\ufeff")]))])
        part = spark.read.schema(own).option("header", True).csv([unquote(p) for p in paths])
        parts.append(part.select(*[F.col(f"`{f.name}`") if f.name in own.names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], "_metadata"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema).withColumn("_metadata", F.struct(F.lit(None).cast("string").alias("file_name")))


def results(spark: SparkSession, glob: str, first_year: int = 2000) -> DataFrame:
    """Results CSV files, whose headers may differ: names beginning with an underscore are skipped, and files of years before first_year."""
    rows = by_name(spark, glob, RESULTS)
    name = F.col("_metadata.file_name")
    year = F.regexp_extract(name, r"((?:19|20)\d\d)", 1).try_cast("int")
    rows = rows.withColumn("source_file", name).withColumn("is_challenger_file", F.contains(F.lower(name), F.lit("chall")).cast("int")).withColumn("_year", year)
    return rows.filter(~F.startswith("source_file", F.lit("_")) & (F.coalesce("_year", F.lit(first_year)) >= first_year)).drop("_year", "_metadata")


def cleaned(rows: DataFrame) -> DataFrame:
    """Typed results with season, level, flags, score fields; impossible rows are dropped, early ends are labelled."""
    typed = rows.select(*[F.trim(c).alias(c) if c in TEXT else tx.number(F.col(c)).alias(c) for c in RESULTS.names], "source_file", "is_challenger_file")
    ok = (F.col("winner_id") != "") & (F.col("loser_id") != "") & (F.col("winner_id") != F.col("loser_id")) & F.col("tourney_date").between(19000101, 21001231)
    level = F.when(F.col("is_challenger_file") == 1, "challenger").otherwise(tx.mapped(F.col("tourney_level"), tx.LEVELS, "other"))
    return (
        tx.with_score(typed.filter(ok), "score")
        .withColumn("season", F.floor(F.col("tourney_date") / 10000).cast("int"))
        .withColumn("level", level)
        .withColumn("indoor", F.when(F.col("indoor") == "I", 1).when(F.col("indoor") == "O", 0))
        .withColumn("round_index", F.array_position(F.array(*map(F.lit, tx.ROUNDS)), F.col("round")))
        .withColumn("has_stats", F.col("w_svpt").isNotNull() & F.col("l_svpt").isNotNull() & (F.col("w_SvGms") > 0))
    )


def in_play_order(rows: DataFrame) -> DataFrame:
    """rows with ``seq``: a number in play order; ids make the order total."""
    return numbered(rows, *[F.col(c).asc_nulls_last() for c in ("tourney_date", "tourney_id", "round_index", "match_num", "winner_id", "loser_id")])


#: A name that readers do not hide.
POINTER = "current"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version_of(spark: SparkSession, path: str) -> str | None:
    """The version that readers of the table at path get, or null where none was committed."""
    store, at = _files(spark, f"{path}/{POINTER}")
    return spark.read.text(at.toString()).first()[0] if store.exists(at) else None


def current_table(spark: SparkSession, path: str) -> DataFrame:
    version = version_of(spark, path)
    if version is None:
        raise ValueError(f"no version of {path} was committed")
    return spark.read.parquet(f"{path}/{version}")


def replace_table(df: DataFrame, path: str, partition_by: list[str] = [], check: Callable[[DataFrame], bool] | None = None) -> DataFrame:  # noqa: B006
    """Replaces the table at path by df (only the partitions df has, if partitioned), once that is written and checked; returns what readers now get.

    A version is written beside the current one, read back and checked (it must have rows, and pass check), and then a pointer file is renamed over the last one: readers see the old rows or
    the new ones, and a reload that fails, or is lost on the way, leaves the old ones. The version before stays for readers that have begun; older ones and the failed are deleted.
    df may read the table it replaces.
    """
    spark, version, before = df.sparkSession, f"version-{uuid.uuid4().hex}", version_of(df.sparkSession, path)
    rows = df
    if partition_by and before is not None:
        old = current_table(spark, path)
        rows = old.join(df.select(*partition_by).distinct(), partition_by, "left_anti").select(*old.columns).unionByName(df)
    store, staged = _files(spark, f"{path}/{version}")
    try:
        rows.write.partitionBy(*partition_by).parquet(staged.toString())
        back = spark.read.parquet(staged.toString())
        if back.isEmpty() or (check is not None and not check(back)):
            raise ValueError(f"the new rows of {path} do not pass; the old ones stay")
    except Exception:
        store.delete(staged, True)
        raise
    _, new = _files(spark, f"{path}/{POINTER}-{version}")
    out = store.create(new, True)
    out.write(version.encode())
    out.close()
    _, pointer = _files(spark, f"{path}/{POINTER}")
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration()).rename(new, pointer, how)
    for entry in store.listStatus(_files(spark, path)[1]):
        if entry.getPath().getName().startswith("version-") and entry.getPath().getName() not in (version, before):
            store.delete(entry.getPath(), True)
    return current_table(spark, path)


def new_files(listing: DataFrame, manifest: DataFrame, current: str = "ongoing") -> DataFrame:
    """Files (name, modified, size) that a manifest does not have as they are; names with ``current`` always count."""
    known = listing.join(manifest, ["name", "modified", "size"], "left_anti")
    return known.unionByName(listing.filter(F.contains("name", F.lit(current)))).distinct()


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """A price workbook as rows of text; needs a pandas Excel engine on the driver, which is the case where one is installed."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda x: x.notna(), None))
