"""Bets on two-way prices: choice of side, settlement, returns, closing-line value, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import expected_value, kelly

EDGE = 0.03


def with_bets(rows: DataFrame, p: str = "p_win", o1: str = "p1_price", o2: str = "p2_price", edge: float = EDGE) -> DataFrame:
    """Rows with an edge, with side (1 or 2), bet_price, bet_p, won and kelly_stake; the first side goes first in ties."""
    ev1, ev2 = expected_value(F.col(p), F.col(o1)), expected_value(1 - F.col(p), F.col(o2))
    first = ev1 >= ev2
    chosen = rows.withColumn("side", F.when(first, 1).otherwise(2)).withColumn("ev", F.when(first, ev1).otherwise(ev2))
    chosen = chosen.filter(F.col("ev") > edge)
    chosen = chosen.withColumn("bet_price", F.when(F.col("side") == 1, F.col(o1)).otherwise(F.col(o2)))
    chosen = chosen.withColumn("other_price", F.when(F.col("side") == 1, F.col(o2)).otherwise(F.col(o1)))
    chosen = chosen.withColumn("bet_p", F.when(F.col("side") == 1, F.col(p)).otherwise(1 - F.col(p)))
    chosen = chosen.withColumn("won", F.when((F.col("side") == 1) == (F.col("y_win") == 1), 1).otherwise(0))
    return chosen.withColumn("kelly_stake", kelly(F.col("bet_p"), F.col("bet_price")))


def profit(stake: Column | float = 1.0) -> Column:
    return stake * F.when(F.col("won") == 1, F.col("bet_price") - 1).otherwise(-1.0)


def returns(prefix: str = "") -> list[Column]:
    """Bets, returns of flat and Kelly stakes, hit rate against its break-even, prices."""
    k = F.col("kelly_stake")
    return [
        F.count("*").alias("bets"), F.round(F.sum(profit()), 4).alias("profit"), F.round(F.avg(profit()) * 100, 4).alias("roi_pct"),
        F.round(F.try_divide(F.sum(profit(k)), F.sum(k)) * 100, 4).alias("kelly_roi_pct"), F.round(F.avg("won"), 6).alias("hit_rate"),
        F.round(F.avg(1 / F.col("bet_price")), 6).alias("breakeven"), F.round(F.avg("bet_price"), 6).alias("avg_price"),
        F.round(F.avg(F.when(F.col("bet_price") > F.col("other_price"), 100.0).otherwise(0.0)), 4).alias("pct_underdog"),
    ]


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from an md5 of its parts: the same in every engine and partitioning."""
    return F.conv(F.substring(_digest(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _digest(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts]))


def poisson_weight(u: Column, most: int = 8) -> Column:
    """A Poisson(1) count from a uniform, by comparing with its cumulative probabilities."""
    import math

    cumulative, out = 0.0, F.lit(0)
    for k in range(most):
        cumulative += math.exp(-1) / math.factorial(k)
        out = out + F.when(u >= cumulative, 1).otherwise(0)
    return out


def poisson_count(*parts: Column | str | int, most: int = 8) -> Column:
    """``poisson_weight(uniform(*parts))`` without the number: the md5's text is compared with the texts of the same bounds, which stops at the first that is greater."""
    import math

    digest, out, cumulative = _digest(*parts), F, 0.0
    for k in range(most):
        cumulative += math.exp(-1) / math.factorial(k)
        out = out.when(digest < f"{math.ceil(cumulative * (1 << 52)):013x}", k)  # u < cumulative, digit by digit
    return out.otherwise(most)


def bootstrap(per_cluster: DataFrame, cluster: str, value: str, weight: str, replicates: int, seed: int = 7) -> DataFrame:
    """replicate, estimate: a Poisson bootstrap of sum(value) / sum(weight) over clusters.

    Clusters are summed first; each gets a Poisson(1) count for each replicate, so the work is clusters times
    replicates and partial sums meet in one row a replicate.
    """
    dealt = per_cluster.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_count(seed, F.col("replicate"), F.col(cluster))
    rows = dealt.withColumn("w", w)
    sums = rows.groupBy("replicate").agg(F.sum(F.col("w") * F.col(value)).alias("v"), F.sum(F.col("w") * F.col(weight)).alias("n"))
    return sums.select(F.col("replicate").cast("long").alias("replicate"), F.round(F.try_divide("v", "n"), 6).alias("estimate"))


def expanding_best(rows: DataFrame, least: int = 100) -> DataFrame:
    """season, weight, trained_on: for each season the weight with the least loss over all seasons before it (the smaller among equals), once those have ``least`` rows or more.

    rows: season, weight, n, loss (a sum). A row a season and weight, so the running sums are over a short table whatever the number of matches; no season sees itself.
    """
    past = Window.partitionBy("weight").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select("season", "weight", F.sum("loss").over(past).alias("past"), F.sum("n").over(past).alias("trained_on")).filter(F.col("trained_on") >= least)
    return before.groupBy("season").agg(F.min_by("weight", F.struct(F.round(F.col("past") / F.col("trained_on"), 9), "weight")).alias("weight"), F.max("trained_on").alias("trained_on"))


def freshest_pairings(rows: DataFrame, a: str, b: str, *order: str) -> DataFrame:
    """The last row, by order, of each pair of names, whichever of them is listed first; it stays as it was listed.

    A match that was put off or listed anew is one pairing, so it is never bet on twice. Rows without one of the names are left out.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    named = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    last = named.groupBy(F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")).agg(F.max_by(whole, F.struct(*order)).alias("_r"))
    return last.select("_r.*")


def with_picks(rows: DataFrame, p: str = "p_model", o1: str = "p1_price", o2: str = "p2_price") -> DataFrame:
    """rows with side (1 or 2: the one of the larger expected value, 1 among equals), price, p_side, ev and stake (capped Kelly) of that side; nulls where there is no chance."""
    ev1, ev2 = expected_value(F.col(p), F.col(o1)), expected_value(1 - F.col(p), F.col(o2))
    out = rows.withColumn("side", F.when(F.round(ev1, 9) >= F.round(ev2, 9), 1).when(F.col(p).isNotNull(), 2))
    first = F.col("side") == 1
    out = out.withColumn("price", F.when(first, F.col(o1)).when(~first, F.col(o2))).withColumn("p_side", F.when(first, F.col(p)).when(~first, 1 - F.col(p)))
    return out.withColumn("ev", expected_value(F.col("p_side"), F.col("price"))).withColumn("stake", kelly(F.col("p_side"), F.col("price")))
