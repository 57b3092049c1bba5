"""Captured prices meet the matches they are for, as one stream of both.

A capture can only belong to a match that is played within BAND of it. Rows of a batch meet each other and those that were kept; then a watermark, LATE behind the last row of
that side which is less far on, says what can still be reached, and only that is kept for the next batch: some days, not a history, and not the batch. Kept rows are a table a
batch, not a row by row store. A pair leaves in the batch that completes it, a match without a capture when none can come any more, so that each leaves once. Rows that come
behind the watermark are left out. Both tables are written by batch from those of the batch before, so a batch that is repeated after a loss replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAND, LATE = "7 days", "2 days"
#: A match that is still open reaches this far behind the watermark: twice BAND, and a day for clocks that change.
REACH = "15 days"
RESULTS = "match_id bigint, play_ts timestamp"
CAPTURES = "match_id bigint, captured_at timestamp, p1_price double, p2_price double, place string"
ROWS = "match_id bigint, at timestamp, p1_price double, p2_price double, place string, played boolean"


def met(results: DataFrame, captures: DataFrame) -> DataFrame:
    """The columns of results and of each capture of the match within BAND before or after play; one row with nulls for a match without any."""
    near = F.expr(f"match_id = _m and captured_at >= play_ts - interval {BAND} and captured_at <= play_ts + interval {BAND}")
    return results.join(captures.withColumnRenamed("match_id", "_m"), near, "left").drop("_m")


def promoted(rows: DataFrame) -> DataFrame:
    """A row a match: the last capture before play (null without one) and how many captures of the band came before and after it."""
    before = F.col("captured_at") <= F.col("play_ts")
    last = F.max_by(F.when(before, F.struct("captured_at", "p1_price", "p2_price")), F.when(before, F.struct("captured_at", "place"))).alias("c")
    counted = rows.groupBy("match_id", "play_ts").agg(last, F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_after"))
    return counted.select("match_id", "play_ts", "c.captured_at", "c.p1_price", "c.p2_price", "n_before", "n_after")


def step(batch: DataFrame, number: int, folder: str) -> None:
    """Writes the pairs that ROWS of a batch complete and the matches that close without one, and what is kept for the next batch."""
    spark = batch.sparkSession
    old = spark.read.schema(ROWS).parquet(f"{folder}/kept/batch={number - 1}") if number else spark.createDataFrame([], ROWS)
    rows = old.withColumn("fresh", F.lit(False)).unionByName(batch.withColumn("fresh", F.lit(True)))
    last = lambda fresh, played: F.max(F.when((F.col("fresh") == fresh) & (F.col("played") == played), F.unix_micros("at")))
    seen = rows.agg(last(False, True), last(False, False), F.greatest(last(False, True), last(True, True)), F.greatest(last(False, False), last(True, False))).first()
    mark = lambda a, b: None if a is None or b is None else F.timestamp_micros(F.lit(min(a, b))) - F.expr(f"interval {LATE}")
    passed, mark = mark(*seen[:2]), mark(*seen[2:])  # the last rows of both sides are always kept
    if passed is not None:
        rows = rows.filter(~F.col("fresh") | F.col("at").isNull() | (F.col("at") > passed))
    open_ = lambda t, reach: F.col(t).isNotNull() if mark is None else F.coalesce(F.col(t) + F.expr(f"interval {reach}") >= mark, F.lit(False))
    results = rows.filter("played").select("match_id", F.col("at").alias("play_ts"), F.col("fresh").alias("_r"))
    captures = rows.filter("not played").select("match_id", F.col("at").alias("captured_at"), "p1_price", "p2_price", "place", F.col("fresh").alias("_c"))
    leaves = F.when(F.col("captured_at").isNull(), ~open_("play_ts", BAND)).otherwise(F.col("_r") | F.col("_c"))
    met(results, captures).filter(leaves).drop("_r", "_c").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    kept = rows.filter(F.when(F.col("played"), open_("at", BAND)).otherwise(open_("at", REACH))).drop("fresh")
    kept.write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")
    past = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/kept/batch={number - 2}")  # the batch before this one is committed
    past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)


def run_batch(spark: SparkSession, folder: str, results: DataFrame, captures: DataFrame) -> None:
    """Adds rows to both inputs in folder and lets the stream go on from its checkpoint over what is there."""
    results.write.mode("append").parquet(f"{folder}/results")
    captures.write.mode("append").parquet(f"{folder}/captures")
    r, c = [spark.readStream.schema(s).parquet(f"{folder}/{n}") for n, s in (("results", RESULTS), ("captures", CAPTURES))]
    both = r.select("match_id", F.col("play_ts").alias("at"), F.lit(True).alias("played")).unionByName(c.withColumnRenamed("captured_at", "at").withColumn("played", F.lit(False)), allowMissingColumns=True)
    both.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(lambda b, i: step(b, i, folder)).trigger(availableNow=True).start().awaitTermination()


def close(spark: SparkSession, folder: str) -> None:
    """Says that no more rows come: a row far ahead on both sides moves the watermark past all others. It has no number and stays open, so it never leaves."""
    run_batch(spark, folder, spark.sql("select null::bigint match_id, timestamp'2262-01-01 00:00:00' play_ts"), spark.sql("select null::bigint match_id, timestamp'2262-01-01 00:00:00' captured_at, 0d p1_price, 0d p2_price, '' place"))


def captured(spark: SparkSession, folder: str) -> DataFrame:
    return promoted(spark.read.parquet(f"{folder}/out"))
