"""The feature frame: every player's form before a match, by side, with differences and their sizes.

Features are named once, as a value of a player's row and a frame of earlier rows; the plan and its SQL are both made from that list.
All frames of one partitioning share a sort, so a feature more costs an aggregate and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import query
from .views import contest, player_match

MARGIN, TOTAL = "CAST(round(margin * 100) AS BIGINT)", "CAST(round(total * 100) AS BIGINT)"  # whole hundredths: their sums do not depend on their order
OWN = "((total + CASE WHEN won = 1 THEN margin ELSE -margin END) / 2e0)"
CLOSE = "CASE WHEN margin < 10 THEN won END"
#: Ten series of shares of one count in another; a count of 0 has no share.
SHARES = {
    "points_share": (OWN, "total"), "lost_share": (f"(total - {OWN})", "total"), "margin_share": ("margin", "total"), "win_margin_share": ("won * margin", "total"), "loss_margin_share": ("(1 - won) * margin", "total"),
    "points_to_lost": (OWN, f"(total - {OWN})"), "lost_to_points": (f"(total - {OWN})", OWN), "close_share": ("CASE WHEN margin < 10 THEN total ELSE 0 END", "total"),
    "short_share": ("CASE WHEN total < 60 THEN total ELSE 0 END", "total"), "even_share": (f"least({OWN}, total - {OWN})", f"greatest({OWN}, total - {OWN})"),
}
#: name: (value, partition, rows back or None for all).
FORM = {
    **{f"win_rate_{n}": ("won", "player_id", n) for n in (10, 25, 50)}, **{f"margin_{n}": (MARGIN, "player_id", n) for n in (10, 25, 50)}, **{f"total_{n}": (TOTAL, "player_id", n) for n in (10, 25, 50)},
    "surface_win_rate_25": ("won", "player_id, surface", 25), "surface_total_25": (TOTAL, "player_id, surface", 25), "career_win_rate": ("won", "player_id", None), "retired_rate": ("CASE WHEN retired THEN 1 ELSE 0 END", "player_id", None),
    "decider_rate": (CLOSE, "player_id", None), "decider_rate_25": (CLOSE, "player_id", 25), "tie_rate_25": ("CASE WHEN margin < 10 THEN 1 ELSE 0 END", "player_id", 25),
    **{f"{name}_25": (f"{a} / nullif({b}, 0)", "player_id", 25) for name, (a, b) in SHARES.items()},
}
SIZED = [n for n in FORM if n.endswith("_25")]


def pairwise(sides: DataFrame, keep: list[str], first: str, names: list[str], sized: list[str]) -> DataFrame:
    """One row a match from two (keep, ``first`` tells which side a row is): p1_x, p2_x, d_x for each name and abs_x for those sized; a missing side makes no difference."""
    value = lambda name, side: F.max(F.when(F.col(first) == F.lit(side), F.col(name)))
    wide = sides.groupBy(*keep).agg(*[value(n, side).alias(f"{p}_{n}") for n in names for side, p in ((True, "p1"), (False, "p2"))])
    return wide.select("*", *[(F.col(f"p1_{n}") - F.col(f"p2_{n}")).alias(f"d_{n}") for n in names], *[F.abs(F.col(f"p1_{n}") - F.col(f"p2_{n}")).alias(f"abs_{n}") for n in sized])


def form_sql() -> str:
    frame = lambda n: "UNBOUNDED PRECEDING" if n is None else f"{n} PRECEDING"
    parts = [f"round(avg({v}) OVER (PARTITION BY {by} ORDER BY match_id ROWS BETWEEN {frame(n)} AND 1 PRECEDING), 5) AS {name}" for name, (v, by, n) in FORM.items()]
    return f"f AS (SELECT match_id, player_id, {', '.join(parts)} FROM player_match)"


def wide_sql() -> str:
    sides = ", ".join(f"a.{n} AS p1_{n}, b.{n} AS p2_{n}, round(a.{n} - b.{n}, 5) + 0 AS d_{n}" for n in FORM)
    sizes = ", ".join(f"round(abs(a.{n} - b.{n}), 5) AS abs_{n}" for n in SIZED)
    return f"""WITH {form_sql()}, o AS (SELECT match_id, winner_id, loser_id, CAST('0x' || left(md5(CAST(match_id AS VARCHAR)), 2) AS INT) % 2 = 0 AS w1 FROM contest)
SELECT o.match_id, CASE WHEN w1 THEN 1 ELSE 0 END AS y_win, {sides}, {sizes} FROM o JOIN f a ON a.match_id = o.match_id AND a.player_id = CASE WHEN w1 THEN winner_id ELSE loser_id END
JOIN f b ON b.match_id = o.match_id AND b.player_id = CASE WHEN w1 THEN loser_id ELSE winner_id END"""


@query("features_pairwise", wide_sql(), "contest player_match")
def features_pairwise(spark, d):
    rows = player_match(contest(spark, d))
    frame = lambda by, n: Window.partitionBy(*by.split(", ")).orderBy("match_id").rowsBetween(Window.unboundedPreceding if n is None else -n, -1)
    form = rows.select("match_id", "won", *[F.round(F.avg(F.expr(v)).over(frame(by, n)), 5).alias(name) for name, (v, by, n) in FORM.items()])
    first = tx.lower_first(F.col("match_id"))
    sides = form.withColumn("y_win", F.when(first, 1).otherwise(0)).withColumn("_first", (F.col("won") == 1) == first)
    out = pairwise(sides, ["match_id", "y_win"], "_first", list(FORM), SIZED)
    return out.select("match_id", "y_win", *[(F.round(c, 5) + 0.0).alias(c) for c in out.columns[2:]])


@query(
    "features_upcoming",
    f"""WITH l AS (SELECT player_id, {', '.join(f"avg({FORM[n][0]}) AS {n}" for n in ("career_win_rate", "decider_rate"))} FROM player_match GROUP BY player_id), x AS (SELECT c_custkey AS p1, c_custkey + 1 AS p2 FROM customer WHERE c_custkey % 2 = 0)
SELECT p1, p2, round(a.career_win_rate, 6) AS p1_career, round(b.career_win_rate, 6) AS p2_career, round(a.career_win_rate - b.career_win_rate, 6) AS d_career, round(a.decider_rate - b.decider_rate, 6) AS d_decider, a.player_id IS NULL AND b.player_id IS NULL AS unknown
FROM x LEFT JOIN l a ON a.player_id = p1 LEFT JOIN l b ON b.player_id = p2""",
    "contest player_match",
)
def features_upcoming(spark, d):
    """Rows to score for fixtures that have not been played, from each player's state after the last match; players without one have nulls."""
    from .views import table

    state = player_match(contest(spark, d)).groupBy("player_id").agg(*[F.avg(F.expr(FORM[n][0])).alias(n) for n in ("career_win_rate", "decider_rate")])
    fixtures = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("p1"), (F.col("c_custkey") + 1).alias("p2"))
    side = lambda p: state.select(F.col("player_id").alias(p), F.col("career_win_rate").alias(f"_c{p}"), F.col("decider_rate").alias(f"_d{p}"))
    both = fixtures.join(side("p1"), "p1", "left").join(side("p2"), "p2", "left")
    return both.select(
        "p1", "p2", F.round("_cp1", 6).alias("p1_career"), F.round("_cp2", 6).alias("p2_career"), F.round(F.col("_cp1") - F.col("_cp2"), 6).alias("d_career"), F.round(F.col("_dp1") - F.col("_dp2"), 6).alias("d_decider"),
        (F.col("_cp1").isNull() & F.col("_cp2").isNull()).alias("unknown"),
    )
