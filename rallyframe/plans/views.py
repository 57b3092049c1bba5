"""The engine's tables, derived from the star schema that is at hand.

contest: results with winner, loser, surface, margin and total. price: quotes of a two-way
book by capture time. forecast: a predicted probability and its outcome. Each is lazy, so
filters and columns reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CAPTURE_ORDER = ("ln", "k1", "k2", "k3", "k4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring events as results: one aggregation on the pair's number, no self-join."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", "value")
    side = F.struct("user_id", "value", "event_type", "ts")
    pairs = e.groupBy(F.expr("event_id div 2").alias("match_id")).agg(
        F.max(F.when(F.col("event_id") % 2 == 0, side)).alias("a"), F.max(F.when(F.col("event_id") % 2 == 1, side)).alias("b")
    )
    first = F.col("a.value") >= F.col("b.value")
    return pairs.filter("a.user_id <> b.user_id").select(
        "match_id",
        F.col("a.ts").alias("ts"),
        F.col("a.event_type").alias("surface"),
        F.when(first, F.col("a.user_id")).otherwise(F.col("b.user_id")).alias("winner_id"),
        F.when(first, F.col("b.user_id")).otherwise(F.col("a.user_id")).alias("loser_id"),
        F.abs(F.col("a.value") - F.col("b.value")).alias("margin"),
        (F.col("a.value") + F.col("b.value")).alias("total"),
        (F.col("b.event_type") == "error").alias("retired"),
    )


def player_match(results: DataFrame) -> DataFrame:
    """Two rows a result, one for each player: the unpivot that all form features start from."""
    sides = F.array(
        F.struct(F.col("winner_id").alias("player_id"), F.col("loser_id").alias("opponent_id"), F.lit(1).alias("won")),
        F.struct(F.col("loser_id").alias("player_id"), F.col("winner_id").alias("opponent_id"), F.lit(0).alias("won")),
    )
    rows = results.select("match_id", "ts", "surface", "margin", "total", "retired", F.explode(sides).alias("s"))
    return rows.select("match_id", "ts", "surface", "s.player_id", "s.opponent_id", "s.won", "margin", "total", "retired")


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p1 = 1.2 + (F.col("l_partkey") % 40) * 0.1
    return li.select(
        F.col("l_orderkey").alias("match_id"), (F.col("l_suppkey") % 12).alias("book"), F.col("l_linenumber").alias("ln"), F.col("l_shipdate").alias("captured_at"),
        p1.alias("p1_price"), (1 / ((1.02 + F.col("l_tax")) - 1 / p1)).alias("p2_price"),
        F.col("l_partkey").alias("k1"), F.col("l_suppkey").alias("k2"), F.col("l_quantity").alias("k3"), F.col("l_extendedprice").alias("k4"),
    )


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("play_ts"), F.year("o_orderdate").cast("long").alias("season"),
        F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(0).alias("y_win"),
        F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("o_totalprice") / 500000)).alias("p_win"), F.col("o_orderpriority").alias("surface"), F.col("o_custkey").alias("player_id"),
    )


def last_capture(prices: DataFrame) -> DataFrame:
    """match_id, p1_price, p2_price of the last capture of each match (a fixed order among ties).

    max_by over a struct: one pre-aggregated shuffle, no sort of a match's quotes.
    """
    order = F.struct("captured_at", *[(-F.col(c)).alias(c) for c in CAPTURE_ORDER])
    best = F.max_by(F.struct("p1_price", "p2_price"), order).alias("q")
    return prices.groupBy("match_id").agg(best).select("match_id", "q.p1_price", "q.p2_price")


def first_capture(prices: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("p1_price", "p2_price"), F.struct("captured_at", *CAPTURE_ORDER)).alias("q")
    return prices.groupBy("match_id").agg(best).select("match_id", F.col("q.p1_price").alias("p1_open"), F.col("q.p2_price").alias("p2_open"))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """forecast with the closing prices and their overround."""
    joined = forecast(spark, sf_dir).join(last_capture(price(spark, sf_dir)), "match_id")
    return joined.withColumn("overround", 1 / F.col("p1_price") + 1 / F.col("p2_price"))


def by_player(*order: str):
    return Window.partitionBy("player_id").orderBy(*(order or ("match_id",)))
