"""Queries on ordered rows: sessions, rolling form, loads, streaks, meetings, order-based cuts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import form
from ..operators.ordering import numbered, running_totals
from .registry import query
from .views import by_player, contest, forecast, player_match, table

PM = "contest player_match"


@query(
    "form_sessions",
    """WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) > 30 THEN 1 ELSE 0 END AS fresh FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS edition FROM g)
SELECT o_custkey, CAST(edition AS BIGINT) AS edition, count(*) AS n, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day FROM e GROUP BY ALL""",
)
def form_sessions(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    rows = form.sessions(orders, ["o_custkey"], "o_orderdate", ["o_orderdate", "o_orderkey"])
    return rows.groupBy("o_custkey", F.col("edition").cast("long").alias("edition")).agg(
        F.count("*").alias("n"), F.min("o_orderdate").cast("date").cast("string").alias("first_day"), F.max("o_orderdate").cast("date").cast("string").alias("last_day")
    )


ROLL = ", ".join(f"round(avg(won) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS win_rate_{n}" for n in (10, 25, 50))


@query("form_rolling_win_rate", f"SELECT match_id, player_id, {ROLL} FROM player_match", PM)
def form_rolling_win_rate(spark, d):
    return player_match(contest(spark, d)).select("match_id", "player_id", *form.rolling(F.col("won"), by_player()))


@query(
    "form_surface_rolling",
    """SELECT match_id, player_id, surface, round(avg(won) OVER (PARTITION BY player_id, surface ORDER BY match_id ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING), 6) AS surface_rate_25,
  round(avg(margin) OVER (PARTITION BY player_id, surface ORDER BY match_id ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING), 8) AS surface_margin_25 FROM player_match""",
    PM,
)
def form_surface_rolling(spark, d):
    w = form.before(Window.partitionBy("player_id", "surface").orderBy("match_id"), 25)
    return player_match(contest(spark, d)).select(
        "match_id", "player_id", "surface", F.round(F.avg("won").over(w), 6).alias("surface_rate_25"), F.round(F.avg("margin").over(w), 8).alias("surface_margin_25")
    )


@query(
    "form_career",
    """SELECT match_id, player_id, count(*) OVER w AS career_n, round(avg(won) OVER w, 6) AS career_rate, round(avg(CASE WHEN retired THEN 1.0 ELSE 0 END) OVER w, 6) AS retired_rate
FROM player_match WINDOW w AS (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    PM,
)
def form_career(spark, d):
    w = form.before(by_player())
    retired = F.when(F.col("retired"), 1.0).otherwise(0.0)
    return player_match(contest(spark, d)).select(
        "match_id", "player_id", F.count("*").over(w).alias("career_n"), F.round(F.avg("won").over(w), 6).alias("career_rate"), F.round(F.avg(retired).over(w), 6).alias("retired_rate")
    )


@query(
    "form_rest_and_load",
    """WITH r AS (SELECT match_id, player_id, CAST(ts AS DATE) AS day, margin FROM player_match),
j AS (SELECT a.match_id, a.player_id, date_diff('day', b.day, a.day) AS gap, b.margin FROM r a LEFT JOIN r b ON a.player_id = b.player_id AND (b.day < a.day OR b.day = a.day AND b.match_id < a.match_id))
SELECT match_id, player_id, min(gap) AS rest_days, count(*) FILTER (WHERE gap <= 14) AS matches_14d, count(*) FILTER (WHERE gap <= 30) AS matches_30d, round(coalesce(sum(margin) FILTER (WHERE gap <= 14), 0), 4) + 0 AS margin_14d FROM j GROUP BY match_id, player_id""",
    PM,
)
def form_rest_and_load(spark, d):
    rows = player_match(contest(spark, d)).withColumn("day", F.to_date("ts"))
    load = lambda days, amount=None: form.load_before(["player_id"], "day", ["match_id"], days, amount)
    return rows.select(
        "match_id", "player_id", F.datediff("day", F.lag("day").over(by_player("day", "match_id"))).cast("long").alias("rest_days"),
        load(14).cast("long").alias("matches_14d"), load(30).cast("long").alias("matches_30d"), (F.round(load(14, F.col("margin")), 4) + 0.0).alias("margin_14d"),
    )


EW = """WITH RECURSIVE r AS (SELECT match_id, player_id, margin, row_number() OVER (PARTITION BY player_id ORDER BY match_id) AS i FROM player_match),
e(match_id, player_id, i, s5, w5, s20, w20) AS (SELECT match_id, player_id, i, margin * (1 - pow(0.5e0, 1/5e0)), 1 - pow(0.5e0, 1/5e0), margin * (1 - pow(0.5e0, 1/20e0)), 1 - pow(0.5e0, 1/20e0) FROM r WHERE i = 1
UNION ALL SELECT r.match_id, r.player_id, r.i, s5 * pow(0.5e0, 1/5e0) + margin * (1 - pow(0.5e0, 1/5e0)), w5 * pow(0.5e0, 1/5e0) + 1 - pow(0.5e0, 1/5e0),
  s20 * pow(0.5e0, 1/20e0) + margin * (1 - pow(0.5e0, 1/20e0)), w20 * pow(0.5e0, 1/20e0) + 1 - pow(0.5e0, 1/20e0) FROM e JOIN r ON r.player_id = e.player_id AND r.i = e.i + 1)
SELECT r.match_id, r.player_id, round(s5 / w5, 4) AS ewma_5, round(s20 / w20, 4) AS ewma_20 FROM r LEFT JOIN e ON e.player_id = r.player_id AND e.i = r.i - 1"""


@query("form_ewma", EW, PM)
def form_ewma(spark, d):
    out = form.ewma_before(player_match(contest(spark, d)), ["player_id"], "match_id", "margin")
    return out.select("match_id", "player_id", *[F.round(c, 4).alias(c) for c in ("ewma_5", "ewma_20")])


@query(
    "form_surface_streak",
    """WITH s AS (SELECT *, CASE WHEN surface = lag(surface) OVER w THEN 0 ELSE 1 END AS sw FROM player_match WINDOW w AS (PARTITION BY player_id ORDER BY match_id)),
i AS (SELECT *, sum(sw) OVER (PARTITION BY player_id ORDER BY match_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT match_id, player_id, surface, row_number() OVER (PARTITION BY player_id, island ORDER BY match_id) - 1 AS streak FROM i""",
    PM,
)
def form_surface_streak(spark, d):
    return form.streak(player_match(contest(spark, d)), ["player_id"], "surface", ["match_id"]).select("match_id", "player_id", "surface", "streak")


@query(
    "form_head_to_head",
    """SELECT c.match_id, count(p.match_id) FILTER (WHERE p.winner_id = c.winner_id) AS h2h_wins, count(p.match_id) FILTER (WHERE p.winner_id = c.loser_id) AS h2h_losses
FROM contest c LEFT JOIN contest p ON p.match_id < c.match_id AND least(p.winner_id, p.loser_id) = least(c.winner_id, c.loser_id) AND greatest(p.winner_id, p.loser_id) = greatest(c.winner_id, c.loser_id) GROUP BY c.match_id""",
    "contest",
)
def form_head_to_head(spark, d):
    return form.head_to_head(contest(spark, d)).select("match_id", "h2h_wins", "h2h_losses")


@query(
    "form_head_to_head_surface",
    """SELECT c.match_id, c.surface, count(p.match_id) FILTER (WHERE p.winner_id = c.winner_id) AS h2h_wins, count(p.match_id) FILTER (WHERE p.winner_id = c.loser_id) AS h2h_losses
FROM contest c LEFT JOIN contest p ON p.match_id < c.match_id AND p.surface = c.surface AND least(p.winner_id, p.loser_id) = least(c.winner_id, c.loser_id) AND greatest(p.winner_id, p.loser_id) = greatest(c.winner_id, c.loser_id) GROUP BY ALL""",
    "contest",
)
def form_head_to_head_surface(spark, d):
    return form.head_to_head(contest(spark, d), ["surface"]).select("match_id", "surface", "h2h_wins", "h2h_losses")


@query(
    "form_opponent_strength",
    """WITH c AS (SELECT *, avg(won) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rate FROM player_match),
o AS (SELECT c.match_id, c.player_id, x.rate AS opp FROM c JOIN c x ON x.match_id = c.match_id AND x.player_id = c.opponent_id)
SELECT match_id, player_id, round(avg(opp) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS opp_strength_10,
  round(avg(opp) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING), 6) AS opp_strength_25 FROM o""",
    PM,
)
def form_opponent_strength(spark, d):
    """The mean of opponents' own records before each meeting; both rows of a match meet by one group and not by a self-join."""
    rows = player_match(contest(spark, d)).withColumn("rate", F.avg("won").over(form.before(by_player())))
    both = Window.partitionBy("match_id").orderBy("won").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("opp", F.when(F.col("won") == 1, F.first("rate").over(both)).otherwise(F.last("rate").over(both)))
    w = by_player()
    return rows.select("match_id", "player_id", F.round(F.avg("opp").over(form.before(w, 10)), 6).alias("opp_strength_10"), F.round(F.avg("opp").over(form.before(w, 25)), 6).alias("opp_strength_25"))


@query(
    "form_last_with_statistics",
    """WITH s AS (SELECT match_id, player_id, avg(total) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS m FROM player_match WHERE NOT retired),
j AS (SELECT p.match_id, p.player_id, s.m FROM player_match p LEFT JOIN s USING (match_id, player_id))
SELECT match_id, player_id, round(last_value(m IGNORE NULLS) OVER (PARTITION BY player_id ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 8) AS total_25 FROM j""",
    PM,
)
def form_last_with_statistics(spark, d):
    """The mean of the last 25 rows that have statistics (here: not retired), carried to the next row.

    Rows without statistics take a partition of their own, so one window over flagged rows serves and nothing is joined back.
    """
    rows = player_match(contest(spark, d))
    own = Window.partitionBy("player_id", "retired").orderBy("match_id").rowsBetween(-24, 0)
    rows = rows.withColumn("m", F.when(~F.col("retired"), F.avg("total").over(own)))
    return rows.select("match_id", "player_id", F.round(form.carried(F.col("m"), by_player()), 8).alias("total_25"))


@query(
    "form_expanding_mean",
    """SELECT match_id, surface, CASE WHEN count(*) OVER w >= 50 THEN round(avg(total) OVER w, 6) END AS reference_line FROM contest
WINDOW w AS (PARTITION BY surface, retired ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "contest",
)
def form_expanding_mean(spark, d):
    rows = contest(spark, d).select("match_id", "surface", "retired", "total")
    sums = running_totals(rows, ["match_id"], {"n": F.lit(1), "t": F.col("total")}, ["surface", "retired"])
    return sums.select("match_id", "surface", F.when(F.col("n") >= 50, F.round(F.col("t") / F.col("n"), 6)).alias("reference_line"))


@query(
    "form_event_extent",
    """SELECT o_orderkey, min(o_orderdate) OVER w AS first_day, CAST(count(DISTINCT o_orderpriority) OVER w AS BIGINT) AS n_kinds FROM orders WINDOW w AS (PARTITION BY o_custkey)""",
)
def form_event_extent(spark, d):
    w = Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", F.min("o_orderdate").over(w).alias("first_day"), F.size(F.collect_set("o_orderpriority").over(w)).cast("long").alias("n_kinds"))


@query(
    "form_keep_last",
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1""",
)
def form_keep_last(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r"))
    return last.select("user_id", "r.event_id", "r.event_type", "r.value")


@query(
    "form_keep_preferred",
    """SELECT least(winner_id, loser_id) AS lo, greatest(winner_id, loser_id) AS hi, match_id, retired FROM (SELECT *, row_number() OVER (PARTITION BY least(winner_id, loser_id), greatest(winner_id, loser_id)
  ORDER BY retired, total DESC, match_id) AS place FROM contest) WHERE place = 1""",
    "contest",
)
def form_keep_preferred(spark, d):
    rows = contest(spark, d).select(F.least("winner_id", "loser_id").alias("lo"), F.greatest("winner_id", "loser_id").alias("hi"), "match_id", "retired", "total")
    return form.first_by(rows, ["lo", "hi"], F.col("retired"), -F.col("total"), F.col("match_id")).select("lo", "hi", "match_id", "retired")


@query(
    "form_chronological_cut",
    """SELECT season, part, count(*) AS n, min(match_id) AS first_match FROM (SELECT season, match_id, CASE WHEN row_number() OVER (PARTITION BY season ORDER BY play_ts, match_id) <= floor(0.85e0 * count(*) OVER (PARTITION BY season)) THEN 'train' ELSE 'calibrate' END AS part FROM forecast) GROUP BY ALL""",
    "forecast",
)
def form_chronological_cut(spark, d):
    rows = forecast(spark, d).select("season", "match_id", "play_ts")
    sizes = rows.groupBy("season").agg(F.count("*").alias("size"))
    train = F.col("place") <= F.floor(0.85 * F.col("size"))
    cut = numbered(rows, "play_ts", "match_id", name="place", by=["season"]).join(sizes, "season").select("season", "match_id", F.when(train, "train").otherwise("calibrate").alias("part"))
    return cut.groupBy("season", "part").agg(F.count("*").alias("n"), F.min("match_id").alias("first_match"))


@query(
    "form_season_boundary",
    """SELECT CAST(CASE WHEN month(play_ts) = 12 AND day(play_ts) >= 25 THEN year(play_ts) + 1 ELSE year(play_ts) END AS BIGINT) AS season, count(*) AS n, round(avg(y_win), 6) AS won FROM forecast GROUP BY 1""",
    "forecast",
)
def form_season_boundary(spark, d):
    return forecast(spark, d).groupBy(form.season_of(F.col("play_ts")).alias("season")).agg(F.count("*").alias("n"), F.round(F.avg("y_win"), 6).alias("won"))


@query(
    "form_top_players",
    "SELECT player_id, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins FROM player_match GROUP BY player_id ORDER BY wins DESC, player_id LIMIT 20",
    PM,
)
def form_top_players(spark, d):
    return player_match(contest(spark, d)).groupBy("player_id").agg(F.count("*").alias("n"), F.sum("won").cast("long").alias("wins")).orderBy(F.desc("wins"), "player_id").limit(20)
