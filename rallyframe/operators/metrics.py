"""Scores of forecasts: classification, regression, calibration, agreement, breakouts.

All are single aggregations over (y, p) rows; rank-based scores need one ordering, which is
done on pre-aggregated distinct scores, so ties cost nothing and one hot score is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import log_loss, logit
from .ordering import quantiles, running_totals

BINS = 10


def classification(y: Column, p: Column) -> list[Column]:
    """n, log_loss, brier, accuracy, precision, recall, f1 as aggregates."""
    hit = F.when(p >= 0.5, 1).otherwise(0)
    tp, called, real = F.sum(hit * y), F.sum(hit), F.sum(y)
    return [
        F.count("*").alias("n"), F.round(log_loss(y, p), 6).alias("log_loss"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"),
        F.round(F.avg(F.when(hit == y, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.try_divide(tp, called), 6).alias("precision"),
        F.round(F.try_divide(tp, real), 6).alias("recall"), F.round(F.try_divide(2 * tp, called + real), 6).alias("f1"),
    ]


def auc(df: DataFrame, y: str, p: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, auc: the Mann-Whitney statistic with tied scores counted half.

    Rows are first counted by distinct score; totals of negatives run within by, over as many tasks as there are ranges.
    """
    counts = df.groupBy(*by, p).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    won = running_totals(counts, [p], {"below": F.col("neg")}, by).withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return won.groupBy(*by).agg(F.round(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def regression(y: Column, p: Column) -> list[Column]:
    """n, mae, rmse, bias, r2 as aggregates."""
    e = p - y
    return [
        F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e), 6).alias("bias"),
        F.round(1 - F.sum(e * e) / (F.var_pop(y) * F.count("*")), 6).alias("r2"),
    ]


def bin_of(p: Column, bins: int = BINS) -> Column:
    """The bin of p among equal edges i / bins, compared edge by edge and clamped to the last."""
    return sum(F.when(p >= i / bins, 1).otherwise(0) for i in range(1, bins)).cast("long")


def calibration(df: DataFrame, y: str, p: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, bin, n, predicted, observed, gap; empty bins do not appear."""
    rows = df.withColumn("bin", bin_of(F.col(p))).groupBy(*by, "bin")
    out = rows.agg(F.count("*").alias("n"), F.avg(p).alias("a"), F.avg(y).alias("b"))
    return out.select(*by, "bin", "n", F.round("a", 6).alias("predicted"), F.round("b", 6).alias("observed"), F.round(F.col("a") - F.col("b"), 6).alias("gap"))


def average_rank(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """df with the average rank of x within by; equal values are a range of the one order, so rows are sorted once."""
    w = Window.partitionBy(*by).orderBy(x)
    same = w.rangeBetween(Window.currentRow, Window.currentRow)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


def ranked(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """df with the average rank of x within by, for groups of any size: distinct values are counted, totals run over ranges, ranks are joined back."""
    counts = df.groupBy(*by, x).agg(F.count("*").alias("_c"))
    ranks = running_totals(counts, [x], {"_below": F.col("_c")}, by).select(*by, x, (F.col("_below") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, [*by, x])


def spearman(df: DataFrame, x: str, y: str, by: list[str], least: int = 4) -> DataFrame:
    """by, n, rho for groups of ``least`` rows or more."""
    ranked = average_rank(average_rank(df, x, by, "_rx"), y, by, "_ry")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("rho")).filter(F.col("n") >= least)


def agreement(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Correlations and differences of two probabilities by group; the median gap comes from ranges of counted values."""
    a, b = F.col(a), F.col(b)
    gap = F.abs(a - b)
    found = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.corr(a, b), 6).alias("pearson"), F.round(F.corr(logit(a), logit(b)), 6).alias("logit_pearson"),
        F.round(F.avg(gap), 6).alias("mean_gap"),
        F.round(F.avg(F.when(gap <= 0.02, 100.0).otherwise(0.0)), 6).alias("pct_within_2"), F.round(F.avg(F.when(gap > 0.10, 100.0).otherwise(0.0)), 6).alias("pct_over_10"),
    )
    middle = quantiles(rows.select(*by, gap.alias("_gap")), "_gap", {"_median": 0.5}, by)
    return found.join(middle, by, "left").withColumn("median_gap", F.round("_median", 6)).drop("_median")
