"""A backfill of day pages that can be stopped anywhere: newest day first, some days a batch, with a ledger of what was done.

A source of keys gives the days; its offset says which spans of days were given, so that a later run goes on below them and also takes days that are new since. Only keys
pass through the driver; the pages of a batch's days are read by the executors. Rows are written before the ledger, both by batch, so a batch that is repeated after
a loss replaces itself, and a day that the ledger knows has its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

LEDGER = "day date, status string, n bigint"
ONE = timedelta(days=1)
Span = tuple[date, date]


def spans_of(text: str) -> list[Span]:
    """Closed spans of days from ``2024-01-01/2024-01-31 2024-03-01/2024-03-01``."""
    return [tuple(map(date.fromisoformat, x.split("/"))) for x in text.split()]


def text_of(spans: list[Span]) -> str:
    """The text of spans, newest first, with those that touch united."""
    out: list[Span] = []
    for lo, hi in sorted(spans, reverse=True):
        if out and hi >= out[-1][0] - ONE:
            out[-1] = (min(lo, out[-1][0]), out[-1][1])
        else:
            out.append((lo, hi))
    return " ".join(f"{lo}/{hi}" for lo, hi in out)


def days_down(first: date, last: date, done: list[Span]) -> Iterator[date]:
    """Days from last down to first that are in no span of done."""
    day = last
    for lo, hi in sorted(done, reverse=True):
        while day > hi and day >= first:
            yield day
            day -= ONE
        day = min(day, lo - ONE)
    while day >= first:
        yield day
        day -= ONE


class _Days(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.first, self.last, self.size = date.fromisoformat(options["first"]), date.fromisoformat(options["last"]), int(options.get("size", "25"))

    def initialOffset(self) -> dict:
        return {"done": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        done = spans_of(start["done"])
        chosen = [d for d, _ in zip(days_down(self.first, self.last, done), range(self.size))]
        return iter([(d,) for d in chosen]), {"done": text_of([*done, *[(d, d) for d in chosen]])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        done = spans_of(start["done"])
        return iter([(d,) for lo, hi in spans_of(end["done"]) for d in days_down(lo, hi, done)])


class DayKeys(DataSource):
    """``day_keys``: the days from option last down to option first, option size of them a batch."""

    @classmethod
    def name(cls) -> str:
        return "day_keys"

    def schema(self) -> str:
        return "day date"

    def simpleStreamReader(self, schema) -> _Days:
        return _Days(self.options)


def table_of(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the backfill with the batch that wrote each row; empty before the first."""
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(store.toString())


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """day, status, n, batch: the last word on each day. A day is ``ok`` with rows, ``empty`` with pages but without rows, ``error`` where a page is missing or broken."""
    rows = table_of(spark, folder, "ledger", LEDGER)
    # days that are read again have negative batches, the last try the lowest
    again = F.when(F.col("batch") < 0, -F.col("batch")).otherwise(0)
    return rows.groupBy("day").agg(F.max_by(F.struct("status", "n", "batch"), again).alias("r")).select("day", "r.*")


def visit(spark: SparkSession, folder: str, days: list[date], number: int, pages: Callable[[list[date]], DataFrame], parse: Callable[[DataFrame], DataFrame]) -> None:
    """Reads the pages (day, page, html) of days, keeps parse's rows (with day and page) of whole days, and then writes the ledger."""
    got = pages(days).select("day", "page", "html")
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, days))).alias("day"))
    known = asked.join(got.groupBy("day").agg(F.count("*").alias("pages"), F.count_if(F.col("html").isNull()).alias("broken")), "day", "left")
    whole = known.filter("broken = 0").select("day")
    parse(got.join(F.broadcast(whole), "day", "left_semi")).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")  # as many days as a batch
    counted = spark.read.parquet(f"{folder}/rows/batch={number}").groupBy("day").agg(F.count("*").alias("n"))
    status = F.when(F.coalesce("pages", F.lit(0)) == 0, "error").when(F.col("broken") > 0, "error").when(F.col("n") > 0, "ok").otherwise("empty")
    out = known.join(counted, "day", "left").select("day", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
    out.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")


def backfill(spark: SparkSession, folder: str, first: date, last: date, pages: Callable[[list[date]], DataFrame], parse: Callable[[DataFrame], DataFrame], size: int = 25) -> None:
    """Goes from last down to first; days that were done are not read again, days that failed are, before the others. Call it again after a loss, or with a wider range."""
    failed = [r.day for r in ledger(spark, folder).filter("status = 'error'").select("day").orderBy(F.desc("day")).collect()]  # keys of days
    number = table_of(spark, folder, "ledger", LEDGER).agg(F.least(F.min("batch"), F.lit(0))).first()[0] or 0
    for i in range(0, len(failed), size):
        number -= 1
        visit(spark, folder, failed[i : i + size], number, pages, parse)
    spark.dataSource.register(DayKeys)
    keys = spark.readStream.format("day_keys").options(first=str(first), last=str(last), size=str(size)).load()

    def keep(batch: DataFrame, n: int) -> None:
        visit(batch.sparkSession, folder, sorted((r.day for r in batch.collect()), reverse=True), n, pages, parse)

    flow = keys.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).start()
    try:
        flow.processAllAvailable()
    finally:
        flow.stop()


def matches(spark: SparkSession, folder: str, schema: str, key: str = "match_id") -> DataFrame:
    """The rows that were kept; of rows with one key that of the newest day, then of the lowest page, stays, as the newest day is read first."""
    rows = table_of(spark, folder, "rows", schema)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("day", -F.col("page"))).alias("r")).select(key, "r.*")
