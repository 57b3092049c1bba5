"""What the corpus operators have in common: written tables, row keys, Arrow batches.

Intermediate results that several later steps read are written once to the folder
that the cluster names in ``spark.checkpoint.dir``. All executors share that folder, so
a lost executor costs a few retried tasks and never a result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local master gets a new one; on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rallyframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: the lineage ends there."""
    return _written(df, new_path(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are deleted when the block ends, or before by ``drop``.

    For steps whose result is itself written before the block ends; nothing may read them later.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for _, path in self.tables:
            self._delete(path)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        self.tables.append((_written(df, path), path))
        return self.tables[-1][0]

    def drop(self, table: DataFrame) -> None:
        for path in [p for t, p in self.tables if t is table]:
            self._delete(path)
        self.tables = [(t, p) for t, p in self.tables if t is not table]

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text as every operator reads it: null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


class Keyed(NamedTuple):
    rows: DataFrame
    by_doc_id: bool

    def doc_id(self) -> Column:
        """doc_id of rows that come from a join by key; taken from key where they are the same, so that it need not travel."""
        return F.col("key") if self.by_doc_id else F.col("doc_id")


def keyed(docs: DataFrame) -> Keyed:
    """Rows (key, doc_id, text, _row): key is a number that no two rows share, _row has all columns of docs.

    doc_id itself where it is unique and never null. Elsewhere rows are numbered in the
    order (doc_id, nulls first; text), by a range sort and each partition's own count.
    """
    rows = docs.select("doc_id", whole_text().alias("text"), F.struct(*docs.columns).alias("_row"))
    odd = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1")
    if odd.isEmpty():
        return Keyed(rows.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text", "_row"), True)
    order = (F.col("doc_id").asc_nulls_first(), F.col("text").asc())
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return Keyed(written(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "_row"), "keyed"), False)


def as_they_came(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows with a _row as rows of docs."""
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


TYPES = {"long": T.LongType(), "int": T.IntegerType(), "str": T.StringType(), "bytes": T.BinaryType(), "bool": T.BooleanType(), "double": T.DoubleType()}


def columns(**types: str | T.DataType) -> T.StructType:
    """A schema; unlike a DDL string it needs no session, so tasks can import it."""
    return T.StructType([T.StructField(n, TYPES[t] if isinstance(t, str) else t) for n, t in types.items()])


def map_batches(df: DataFrame, schema: T.StructType, each: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """mapInArrow where each() makes a dict of columns of a batch."""
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = each(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
