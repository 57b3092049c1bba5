"""Streams of events and captures: windows, sessions, duplicates, latest values, running ratings of form.

A stream reads files as they come, holds its state in checkpoints in the folder it is given, and runs on what is there
(``availableNow``) or on. Results go through ``foreachBatch`` as (batch, row) Parquet, so a repeated batch
replaces itself, and ``settled`` gives the last row of each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 days"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """events as a stream, with ts as a timestamp (a timestamp without zone has no watermark)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_now(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what is there and returns its rows with the batch that wrote them."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    flow = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    flow.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows")


def settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def newest(rows: DataFrame) -> DataFrame:
    """The rows of the last batch, for streams that write their whole result in each."""
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch")


def windowed(stream: DataFrame, size: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and kind; rows later than LATE are left out."""
    return (
        stream.withWatermark("ts", LATE)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def editions(stream: DataFrame, gap: str = "1 day") -> DataFrame:
    """Sessions of each user: a gap of more than ``gap`` ends one."""
    return (
        stream.withWatermark("ts", LATE)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def without_repeats(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def latest(stream: DataFrame, key: str) -> DataFrame:
    """The latest value of each key: what a closing price is made from."""
    newest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r")
    return stream.groupBy(key).agg(newest).select(key, "r.event_id", "r.event_type", "r.value")


def running_form(stream: DataFrame, half_life: float = 20.0) -> DataFrame:
    """user_id, n, form: a running exponential mean of each user's values in event order, held as state.

    A batch's rows of a user are sorted by event_id; a user's state is two sums and a count.
    """
    keep = 0.5 ** (1 / half_life)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, w = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        for x in rows["value"].tolist():
            n, s, w = n + 1, s * keep + x * (1 - keep), w * keep + (1 - keep)
        state.update((n, s, w))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "form": [s / w if w else None]})

    rows = stream.select("user_id", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id bigint, n bigint, form double", "n bigint, s double, w double", "update", GroupStateTimeout.NoTimeout)
