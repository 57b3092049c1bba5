"""The flagship: from raw events to scored pre-match ratings and form, by surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market as mk
from ..operators import form, metrics, ratings
from .registry import query
from .scores import CLASSIFY
from .values import ELO_SQL, SURFACE_SQL, pooled
from .views import by_player, contest, player_match


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a contest, sides oriented without looking at the outcome: ratings, form, meetings and labels, all from before it."""
    from ..functions.text import lower_first

    results = contest(spark, sf_dir)
    w = by_player()
    rows = player_match(results)
    long = rows.select("match_id", "player_id", "won", *form.rolling(F.col("won"), w), F.count("*").over(form.before(w)).alias("career_n"))
    both = long.groupBy("match_id").agg(
        *[F.max(F.when(F.col("won") == k, F.col(c))).alias(f"{side}_{c}") for side, k in (("w", 1), ("l", 0)) for c in ("win_rate_10", "win_rate_25", "win_rate_50", "career_n")]
    )
    rated = ratings.elo(pooled(spark, sf_dir), ["pool"]).drop("pool")
    met = form.head_to_head(results).select("match_id", "surface", "winner_id", "loser_id", "margin", "total", "h2h_wins", "h2h_losses")
    joined = met.join(both, "match_id").join(rated, "match_id").withColumn("first", lower_first(F.col("match_id")))
    sides = []
    for c in ("win_rate_10", "win_rate_25", "win_rate_50", "career_n", "elo", "surface_elo"):
        w_, l_ = F.col(f"w_{c}"), F.col(f"l_{c}")
        p1, p2 = F.when(F.col("first"), w_).otherwise(l_), F.when(F.col("first"), l_).otherwise(w_)
        sides += [p1.alias(f"p1_{c}"), p2.alias(f"p2_{c}"), (p1 - p2).alias(f"diff_{c}")]
    sign = F.when(F.col("first"), 1).otherwise(-1)
    return joined.select("match_id", "surface", *sides, (sign * (F.col("h2h_wins") - F.col("h2h_losses"))).alias("h2h_diff"), F.when(F.col("first"), 1).otherwise(0).alias("y_win"), (sign * F.col("margin")).alias("y_spread"), F.col("total").alias("y_total"))


SIDE = ("win_rate_10", "win_rate_25", "win_rate_50", "career_n", "elo", "surface_elo")
FEATURES = f"""{SURFACE_SQL[: SURFACE_SQL.rindex("SELECT m.pool")]}, f AS (SELECT match_id, won, {", ".join(f"round(avg(won) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS win_rate_{n}" for n in (10, 25, 50))},
  count(*) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS career_n FROM player_match),
g AS (SELECT f.*, CASE WHEN won = 1 THEN e.r ELSE e.s END AS elo, CASE WHEN won = 1 THEN e.f ELSE e.x END AS surface_elo FROM f JOIN e ON e.kind = 'm' AND e.id = CAST(f.match_id AS VARCHAR)),
k AS (SELECT c.match_id, c.surface, c.margin, c.total, CAST('0x' || left(md5(CAST(c.match_id AS VARCHAR)), 2) AS INT) % 2 = 0 AS first, count(p.match_id) FILTER (WHERE p.winner_id = c.winner_id) - count(p.match_id) FILTER (WHERE p.winner_id = c.loser_id) AS met FROM contest c
  LEFT JOIN contest p ON p.match_id < c.match_id AND least(p.winner_id, p.loser_id) = least(c.winner_id, c.loser_id) AND greatest(p.winner_id, p.loser_id) = greatest(c.winner_id, c.loser_id) GROUP BY ALL)
SELECT k.match_id, surface, {", ".join(f"round(a.{c}, 6) AS p1_{c}, round(b.{c}, 6) AS p2_{c}, round(a.{c} - b.{c}, 6) + 0 AS diff_{c}" for c in SIDE)}, CASE WHEN first THEN met ELSE -met END AS h2h_diff, CASE WHEN first THEN 1 ELSE 0 END AS y_win,
  CASE WHEN first THEN margin ELSE -margin END AS y_spread, total AS y_total FROM k JOIN g a ON a.match_id = k.match_id AND (a.won = 1) = first JOIN g b ON b.match_id = k.match_id AND (b.won = 1) <> first"""


@query("flagship_features", FEATURES, "contest player_match")
def flagship_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    plain = ("match_id", "surface", "h2h_diff", "y_win", "y_spread", "y_total")
    return rows.select(*[c if c in plain or c.endswith("career_n") else (F.round(c, 6) + 0.0).alias(c) for c in rows.columns])


ELO_STEPS = ELO_SQL[: ELO_SQL.rindex("SELECT m.pool")]
SCORECARD = f"""{ELO_STEPS}, x AS (SELECT m.pool AS surface, m.match_id, e.r AS w, e.r2 AS l, CAST('0x' || left(md5(CAST(m.match_id AS VARCHAR)), 2) AS INT) % 2 = 0 AS first FROM e JOIN m ON e.id = CAST(m.match_id AS VARCHAR) WHERE kind = 'm'),
s AS (SELECT surface, CASE WHEN first THEN 1 ELSE 0 END AS y_win, 1 / (1 + pow(10, (CASE WHEN first THEN l - w ELSE w - l END) / 400)) AS p_win FROM x)
SELECT surface, {CLASSIFY} FROM s GROUP BY surface"""


@query("flagship_scorecard", SCORECARD, "contest")
def flagship_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the rating's chances by surface."""
    rows = features(spark, sf_dir).withColumn("p", mk.clipped(ratings.expected(F.col("p1_elo"), F.col("p2_elo"))))
    return rows.groupBy("surface").agg(*metrics.classification(F.col("y_win"), F.col("p")))
