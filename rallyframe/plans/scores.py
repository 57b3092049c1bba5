"""Queries on forecasts and prices: scores, margins, returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..operators import betting, metrics, ratings
from ..operators import relational as rel
from ..operators.ordering import quantiles
from ..session import written
from .joins import FEED_NAME, KEYED, PLAIN
from .registry import query
from .views import CAPTURE_ORDER, first_capture, forecast, last_capture, price, priced, table

CLASSIFY = """count(*) AS n,
  round(-avg(CASE WHEN y_win = 1 THEN ln(p_win) ELSE ln(1 - p_win) END), 6) AS log_loss, round(avg((p_win - y_win) * (p_win - y_win)), 6) AS brier,
  round(avg(CASE WHEN (p_win >= 0.5) = (y_win = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy,
  round(sum(CASE WHEN p_win >= 0.5 THEN y_win ELSE 0 END) / nullif(sum(CASE WHEN p_win >= 0.5 THEN 1 ELSE 0 END), 0), 6) AS "precision",
  round(sum(CASE WHEN p_win >= 0.5 THEN y_win ELSE 0 END) / nullif(sum(y_win), 0), 6) AS recall,
  round(2 * sum(CASE WHEN p_win >= 0.5 THEN y_win ELSE 0 END) / nullif(sum(CASE WHEN p_win >= 0.5 THEN 1 ELSE 0 END) + sum(y_win), 0), 6) AS f1"""


@query("metrics_classification", f"SELECT {CLASSIFY} FROM forecast", "forecast")
def metrics_classification(spark, d):
    return forecast(spark, d).agg(*metrics.classification(F.col("y_win"), F.col("p_win")))


@query("metrics_by_season", f"SELECT season, {CLASSIFY} FROM forecast GROUP BY season", "forecast")
def metrics_by_season(spark, d):
    return forecast(spark, d).groupBy("season").agg(*metrics.classification(F.col("y_win"), F.col("p_win")))


@query(
    "metrics_breakouts",
    f"""SELECT CASE WHEN grouping(surface) = 0 THEN 'surface' ELSE 'season' END AS dimension,
  coalesce(surface, CAST(season AS VARCHAR)) AS level, {CLASSIFY} FROM forecast GROUP BY GROUPING SETS ((surface), (season)) HAVING count(*) >= 30""",
    "forecast",
)
def metrics_breakouts(spark, d):
    """All dimensions in one pass with grouping sets; small cells are left out."""
    rows = forecast(spark, d)
    cells = rows.groupingSets([["surface"], ["season"]], "surface", "season").agg(F.grouping("surface").alias("g"), *metrics.classification(F.col("y_win"), F.col("p_win")))
    cells = cells.filter("n >= 30")
    level = F.coalesce("surface", F.col("season").cast("string")).alias("level")
    return cells.select(F.when(F.col("g") == 0, "surface").otherwise("season").alias("dimension"), level, *[c for c in cells.columns if c not in ("surface", "season", "g")])


@query(
    "metrics_auc",
    """WITH r AS (SELECT season, y_win, rank() OVER (PARTITION BY season ORDER BY p_win) + (count(*) OVER (PARTITION BY season, p_win) - 1) / 2 AS k FROM forecast)
SELECT season, round((sum(CASE WHEN y_win = 1 THEN k END) - sum(y_win) * (sum(y_win) + 1) / 2) / (sum(y_win) * sum(1 - y_win)), 6) AS auc FROM r GROUP BY season""",
    "forecast",
)
def metrics_auc(spark, d):
    return metrics.auc(forecast(spark, d), "y_win", "p_win", ["season"])


BIN = " + ".join(f"(CASE WHEN p_win >= {i} / 10 THEN 1 ELSE 0 END)" for i in range(1, 10))


@query(
    "metrics_calibration",
    f"""SELECT surface, CAST({BIN} AS BIGINT) AS bin, count(*) AS n, round(avg(p_win), 6) AS predicted, round(avg(y_win), 6) AS observed,
  round(avg(p_win) - avg(y_win), 6) AS gap FROM forecast GROUP BY ALL""",
    "forecast",
)
def metrics_calibration(spark, d):
    return metrics.calibration(forecast(spark, d), "y_win", "p_win", ["surface"])


@query(
    "metrics_regression",
    """SELECT book, count(*) AS n, round(avg(abs(p1_price - p2_price)), 6) AS mae, round(sqrt(avg((p1_price - p2_price) ** 2)), 6) AS rmse, round(avg(p1_price - p2_price), 6) AS bias,
  round(1 - sum((p1_price - p2_price) ** 2) / (var_pop(p2_price) * count(*)), 6) AS r2 FROM price GROUP BY book""",
    "price",
)
def metrics_regression(spark, d):
    return price(spark, d).groupBy("book").agg(*metrics.regression(F.col("p2_price"), F.col("p1_price")))


@query(
    "metrics_histogram",
    "SELECT season, CAST(floor(p_win * 20) AS BIGINT) AS bin, count(*) AS n FROM forecast WHERE season >= 1994 GROUP BY ALL",
    "forecast",
)
def metrics_histogram(spark, d):
    return forecast(spark, d).filter("season >= 1994").groupBy("season", F.floor(F.col("p_win") * 20).cast("long").alias("bin")).agg(F.count("*").alias("n"))


SHIN = "(CASE WHEN overround >= 1 THEN 1 / p1_price - (overround - 1) / 2 ELSE (1 / p1_price) / overround END)"


@query(
    "metrics_agreement",
    f"""WITH s AS (SELECT season, p_win AS a, {SHIN} AS b FROM priced)
SELECT season, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ln(a / (1 - a)), ln(b / (1 - b))), 6) AS logit_pearson, round(avg(abs(a - b)), 6) AS mean_gap,
  round(median(abs(a - b)), 6) AS median_gap, round(avg(CASE WHEN abs(a - b) <= 0.02 THEN 100.0 ELSE 0 END), 6) AS pct_within_2,
  round(avg(CASE WHEN abs(a - b) > 0.10 THEN 100.0 ELSE 0 END), 6) AS pct_over_10 FROM s GROUP BY season""",
    "forecast price closing priced",
)
def metrics_agreement(spark, d):
    rows = priced(spark, d).withColumn("p_market", mk.shin(F.col("p1_price"), F.col("p2_price")))
    return metrics.agreement(rows, "p_win", "p_market", ["season"])


@query(
    "metrics_disagreement_buckets",
    f"""WITH s AS (SELECT y_win, p_win, abs(p_win - {SHIN}) AS g FROM priced)
SELECT CASE WHEN g <= 0.02 THEN '0-2' WHEN g <= 0.05 THEN '2-5' WHEN g <= 0.1 THEN '5-10' WHEN g <= 0.2 THEN '10-20' ELSE '20+' END AS bucket, count(*) AS n, round(avg(y_win), 6) AS won,
  round(avg(p_win), 6) AS predicted FROM s GROUP BY 1""",
    "forecast price closing priced",
)
def metrics_disagreement_buckets(spark, d):
    g = F.abs(F.col("p_win") - mk.shin(F.col("p1_price"), F.col("p2_price")))
    bucket = F.when(g <= 0.02, "0-2").when(g <= 0.05, "2-5").when(g <= 0.1, "5-10").when(g <= 0.2, "10-20").otherwise("20+")
    return priced(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("y_win"), 6).alias("won"), F.round(F.avg("p_win"), 6).alias("predicted"))


@query(
    "metrics_spearman_ladder",
    """WITH c AS (SELECT match_id, ln, max(p1_price) AS p FROM price GROUP BY ALL),
r AS (SELECT match_id, rank() OVER (PARTITION BY match_id ORDER BY ln) + (count(*) OVER (PARTITION BY match_id, ln) - 1) / 2 AS a,
  rank() OVER (PARTITION BY match_id ORDER BY p) + (count(*) OVER (PARTITION BY match_id, p) - 1) / 2 AS b FROM c)
SELECT match_id, count(*) AS n, round(corr(a, b), 6) + 0 AS rho FROM r GROUP BY match_id HAVING count(*) >= 4 AND var_pop(a) > 0 AND var_pop(b) > 0""",
    "price",
)
def metrics_spearman_ladder(spark, d):
    rungs = price(spark, d).groupBy("match_id", "ln").agg(F.max("p1_price").alias("p"))
    out = metrics.spearman(rungs, "ln", "p", ["match_id"])
    return out.filter("rho is not null").select("match_id", "n", (F.round("rho", 6) + 0.0).alias("rho"))


@query(
    "market_overround",
    """SELECT book, count(*) AS n, round(median(1 / p1_price + 1 / p2_price), 6) AS overround, round((1 - 1 / median(1 / p1_price + 1 / p2_price)) * 100, 6) AS vig_pct
FROM price WHERE p1_price > 1.001 AND p2_price > 1.001 AND 1 / p1_price + 1 / p2_price BETWEEN 0.96 AND 1.2 GROUP BY book""",
    "price",
)
def market_overround(spark, d):
    over = mk.overround(F.col("p1_price"), F.col("p2_price"))
    sane = price(spark, d).filter((F.col("p1_price") > 1.001) & (F.col("p2_price") > 1.001)).withColumn("o", over).filter(F.col("o").between(0.96, 1.2))
    middle = quantiles(sane, "o", {"middle": 0.5}, ["book"])
    return sane.groupBy("book").agg(F.count("*").alias("n")).join(middle, "book").select("book", "n", F.round("middle", 6).alias("overround"), F.round(mk.vig_percent(F.col("middle")), 6).alias("vig_pct"))


@query(
    "market_devig",
    f"""SELECT match_id, round((1 / p1_price) / overround, 6) AS proportional, round({SHIN}, 6) AS shin,
  round(CASE WHEN overround > 1 THEN ((overround - 1) * ((1 / p1_price - 1 / p2_price) ** 2 - overround)) / (overround * ((1 / p1_price - 1 / p2_price) ** 2 - 1)) ELSE 0 END, 6) AS shin_z FROM priced""",
    "forecast price closing priced",
)
def market_devig(spark, d):
    o1, o2 = F.col("p1_price"), F.col("p2_price")
    return priced(spark, d).select("match_id", F.round(mk.proportional(o1, o2), 6).alias("proportional"), F.round(mk.shin(o1, o2), 6).alias("shin"), F.round(mk.shin_z(o1, o2), 6).alias("shin_z"))


@query(
    "market_devig_power",
    """WITH RECURSIVE q AS (SELECT DISTINCT p1_price AS o1, p2_price AS o2 FROM priced),
k(o1, o2, lo, hi, i) AS (SELECT o1, o2, 2e-1, 3e0, 0 FROM q UNION ALL
  SELECT o1, o2, CASE WHEN pow(1 / o1, (lo + hi) / 2) + pow(1 / o2, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN pow(1 / o1, (lo + hi) / 2) + pow(1 / o2, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM k WHERE i < 60)
SELECT p.match_id, round(pow(1 / o1, (lo + hi) / 2) / (pow(1 / o1, (lo + hi) / 2) + pow(1 / o2, (lo + hi) / 2)), 6) AS power
FROM priced p JOIN k ON p.p1_price = k.o1 AND p.p2_price = k.o2 AND k.i = 60""",
    "forecast price closing priced",
)
def market_devig_power(spark, d):
    return priced(spark, d).select("match_id", F.round(mk.power(F.col("p1_price"), F.col("p2_price")), 6).alias("power"))


@query(
    "market_compare_methods",
    f"""WITH m AS (SELECT 'proportional' AS method, y_win, (1 / p1_price) / overround AS p FROM priced UNION ALL SELECT 'shin', y_win, {SHIN} FROM priced)
SELECT method, round(-avg(CASE WHEN y_win = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, round(avg((p - y_win) ** 2), 6) AS brier, round(avg(greatest(p, 1 - p)), 6) AS favourite FROM m GROUP BY method""",
    "forecast price closing priced",
)
def market_compare_methods(spark, d):
    o1, o2 = F.col("p1_price"), F.col("p2_price")
    methods = F.array(F.struct(F.lit("proportional").alias("method"), mk.proportional(o1, o2).alias("p")), F.struct(F.lit("shin").alias("method"), mk.shin(o1, o2).alias("p")))
    rows = priced(spark, d).select("y_win", F.explode(methods).alias("m")).select("y_win", "m.method", "m.p")
    return rows.groupBy("method").agg(
        F.round(mk.log_loss(F.col("y_win"), F.col("p")), 6).alias("log_loss"),
        F.round(F.avg((F.col("p") - F.col("y_win")) ** 2), 6).alias("brier"),
        F.round(F.avg(F.greatest(F.col("p"), 1 - F.col("p"))), 6).alias("favourite"),
    )


BETS = """bets AS (SELECT *, CASE WHEN side = 1 THEN p1_price ELSE p2_price END AS bet_price, CASE WHEN side = 1 THEN p2_price ELSE p1_price END AS other_price,
  CASE WHEN side = 1 THEN p_win ELSE 1 - p_win END AS bet_p, CASE WHEN (side = 1) = (y_win = 1) THEN 1 ELSE 0 END AS won FROM
  (SELECT *, CASE WHEN p_win * p1_price - 1 >= (1 - p_win) * p2_price - 1 THEN 1 ELSE 2 END AS side, greatest(p_win * p1_price - 1, (1 - p_win) * p2_price - 1) AS ev FROM priced) WHERE ev > 0.03),
settled AS (SELECT *, CASE WHEN won = 1 THEN bet_price - 1 ELSE -1.0 END AS unit, greatest(0, least(0.05, (bet_p * (bet_price - 1) - (1 - bet_p)) / (bet_price - 1))) AS k FROM bets)"""
RETURNS = """count(*) AS bets, round(sum(unit), 4) AS profit, round(avg(unit) * 100, 4) AS roi_pct, round(sum(k * unit) / nullif(sum(k), 0) * 100, 4) AS kelly_roi_pct,
  round(avg(won), 6) AS hit_rate, round(avg(1 / bet_price), 6) AS breakeven, round(avg(bet_price), 6) AS avg_price, round(avg(CASE WHEN bet_price > other_price THEN 100.0 ELSE 0 END), 4) AS pct_underdog"""
MARKET = "forecast price closing priced"


@query("market_roi", f"WITH {BETS} SELECT {RETURNS} FROM settled", MARKET)
def market_roi(spark, d):
    return betting.with_bets(priced(spark, d)).agg(*betting.returns())


@query("market_roi_by_season", f"WITH {BETS} SELECT season, {RETURNS} FROM settled GROUP BY season", MARKET)
def market_roi_by_season(spark, d):
    return betting.with_bets(priced(spark, d)).groupBy("season").agg(*betting.returns())


@query(
    "market_roi_summary",
    f"""WITH {BETS}, s AS (SELECT season, avg(unit) * 100 AS roi FROM settled GROUP BY season)
SELECT count(*) FILTER (WHERE roi > 0) AS profitable, max_by(season, roi) AS best_season, min_by(season, roi) AS worst_season, round(stddev_samp(roi), 4) AS sd FROM s""",
    MARKET,
)
def market_roi_summary(spark, d):
    seasons = betting.with_bets(priced(spark, d)).groupBy("season").agg((F.avg(betting.profit()) * 100).alias("roi"))
    return seasons.agg(
        F.count_if(F.col("roi") > 0).alias("profitable"), F.max_by("season", "roi").alias("best_season"), F.min_by("season", "roi").alias("worst_season"), F.round(F.stddev_samp("roi"), 4).alias("sd")
    )


@query(
    "market_strategies",
    f"""WITH {BETS}, g AS (SELECT *, CASE WHEN bet_price > other_price THEN 'underdog' ELSE 'favourite' END AS strategy FROM settled
UNION ALL SELECT *, CASE WHEN bet_price < 1.5 THEN 'price<1.5' WHEN bet_price < 2.5 THEN 'price 1.5-2.5' ELSE 'price>=2.5' END FROM settled)
SELECT strategy, count(*) AS bets, round(avg(unit) * 100, 4) AS roi_pct, round(sum(k / 2 * unit) / nullif(sum(k / 2), 0) * 100, 4) AS half_kelly_roi_pct FROM g GROUP BY strategy HAVING count(*) >= 25""",
    MARKET,
)
def market_strategies(spark, d):
    b = F.col("bet_price")
    tags = F.array(F.when(b > F.col("other_price"), "underdog").otherwise("favourite"), F.when(b < 1.5, "price<1.5").when(b < 2.5, "price 1.5-2.5").otherwise("price>=2.5"))
    rows = betting.with_bets(priced(spark, d)).withColumn("strategy", F.explode(tags))
    half = F.col("kelly_stake") / 2
    out = rows.groupBy("strategy").agg(
        F.count("*").alias("bets"), F.round(F.avg(betting.profit()) * 100, 4).alias("roi_pct"), F.round(F.try_divide(F.sum(betting.profit(half)), F.sum(half)) * 100, 4).alias("half_kelly_roi_pct")
    )
    return out.filter("bets >= 25")


@query(
    "market_closing_line_value",
    f"""WITH j AS (SELECT p.*, o.p1_open, o.p2_open FROM priced p JOIN opening o USING (match_id)),
b AS (SELECT *, CASE WHEN p_win * p1_open - 1 >= (1 - p_win) * p2_open - 1 THEN 1 ELSE 2 END AS side, greatest(p_win * p1_open - 1, (1 - p_win) * p2_open - 1) AS ev FROM j),
c AS (SELECT season, CASE WHEN side = 1 THEN 1 / p1_price - 1 / p1_open ELSE 1 / p2_price - 1 / p2_open END * 100 AS clv FROM b WHERE ev > 0.03)
SELECT season, count(*) AS bets, round(avg(clv), 6) AS clv_pts, round(avg(CASE WHEN clv > 0 THEN 100.0 ELSE 0 END), 4) AS beat_pct,
  round((avg(CASE WHEN clv > 0 THEN 1.0 ELSE 0 END) - 0.5) / (0.5 / sqrt(count(*))), 4) AS z, round(stddev_samp(clv) / sqrt(count(*)), 6) AS se FROM c GROUP BY season""",
    "forecast price closing opening priced",
)
def market_closing_line_value(spark, d):
    rows = priced(spark, d).join(first_capture(price(spark, d)), "match_id")
    bets = betting.with_bets(rows, o1="p1_open", o2="p2_open")
    clv = F.when(F.col("side") == 1, 1 / F.col("p1_price") - 1 / F.col("p1_open")).otherwise(1 / F.col("p2_price") - 1 / F.col("p2_open")) * 100
    rows = bets.select("season", clv.alias("clv")).withColumn("beat", F.when(F.col("clv") > 0, 1.0).otherwise(0.0))
    n = F.sqrt(F.count("*"))
    return rows.groupBy("season").agg(
        F.count("*").alias("bets"), F.round(F.avg("clv"), 6).alias("clv_pts"), F.round(F.avg("beat") * 100, 4).alias("beat_pct"),
        F.round((F.avg("beat") - 0.5) / (0.5 / n), 4).alias("z"), F.round(F.stddev_samp("clv") / n, 6).alias("se"),
    )


@query(
    "market_controls",
    """WITH s AS (SELECT unnest([CASE WHEN p1_price <= p2_price THEN 'favourite' ELSE 'underdog' END, 'first']) AS strategy, p1_price AS o, y_win AS won FROM priced
UNION ALL SELECT unnest([CASE WHEN p1_price <= p2_price THEN 'underdog' ELSE 'favourite' END, 'second']), p2_price, 1 - y_win FROM priced)
SELECT strategy, count(*) AS bets, round(avg(won * o - 1) * 100, 4) AS roi_pct, round(avg(won), 6) AS hit_rate FROM s GROUP BY strategy""",
    MARKET,
)
def market_controls(spark, d):
    """Returns of rules that know nothing: always the favourite, the underdog, the first or the second side."""
    low = F.col("p1_price") <= F.col("p2_price")
    bet = lambda name, o, won: F.struct(name.alias("strategy"), o.alias("o"), won.alias("won"))
    one, two = (F.col("p1_price"), F.col("y_win")), (F.col("p2_price"), 1 - F.col("y_win"))
    bets = F.array(bet(F.when(low, "favourite").otherwise("underdog"), *one), bet(F.lit("first"), *one), bet(F.when(low, "underdog").otherwise("favourite"), *two), bet(F.lit("second"), *two))
    rows = priced(spark, d).select(F.explode(bets).alias("b")).select("b.*")
    return rows.groupBy("strategy").agg(F.count("*").alias("bets"), F.round(F.avg(F.col("won") * F.col("o") - 1) * 100, 4).alias("roi_pct"), F.round(F.avg("won"), 6).alias("hit_rate"))


@query(
    "market_price_move",
    """WITH m AS (SELECT match_id, median(p1_price) AS m1, median(p2_price) AS m2 FROM price GROUP BY match_id), j AS (SELECT p.*, o.p1_open, o.p2_open, m1, m2 FROM priced p JOIN opening o USING (match_id) JOIN m USING (match_id)),
b AS (SELECT *, CASE WHEN p_win * p1_open - 1 >= (1 - p_win) * p2_open - 1 THEN 1 ELSE 2 END AS side, greatest(p_win * p1_open - 1, (1 - p_win) * p2_open - 1) AS ev FROM j),
c AS (SELECT season, CASE WHEN side = 1 THEN p1_open / p1_price ELSE p2_open / p2_price END - 1 AS move, CASE WHEN side = 1 THEN p1_open > 1.15 * m1 ELSE p2_open > 1.15 * m2 END AS stale FROM b WHERE ev > 0.03)
SELECT season, count(*) AS bets, round(avg(move) * 100, 4) AS move_pct, count(*) FILTER (WHERE stale) AS stale, round(avg(move) FILTER (WHERE NOT stale) * 100, 4) AS fresh_move_pct FROM c GROUP BY season""",
    "forecast price closing opening priced",
)
def market_price_move(spark, d):
    """How far the price of bets at the opening moved by the close, also without quotes that stood 15 percent above the books' median."""
    quotes = price(spark, d)
    middle = quotes.groupBy("match_id").agg(F.median("p1_price").alias("m1"), F.median("p2_price").alias("m2"))
    bets = betting.with_bets(priced(spark, d).join(first_capture(quotes), "match_id").join(middle, "match_id"), o1="p1_open", o2="p2_open")
    first = F.col("side") == 1
    move = F.when(first, F.col("p1_open") / F.col("p1_price")).otherwise(F.col("p2_open") / F.col("p2_price")) - 1
    rows = bets.select("season", move.alias("move"), F.when(first, F.col("p1_open") > 1.15 * F.col("m1")).otherwise(F.col("p2_open") > 1.15 * F.col("m2")).alias("stale"))
    return rows.groupBy("season").agg(
        F.count("*").alias("bets"), F.round(F.avg("move") * 100, 4).alias("move_pct"), F.count_if("stale").alias("stale"), F.round(F.avg(F.when(~F.col("stale"), F.col("move"))) * 100, 4).alias("fresh_move_pct")
    )


@query(
    "market_open_vs_close",
    """WITH j AS (SELECT c.match_id, c.p1_price, o.p1_open, f.season FROM closing c JOIN opening o USING (match_id) JOIN forecast f USING (match_id))
SELECT season, count(*) AS n, round(avg(p1_price - p1_open), 6) AS mean_move, round(avg(CASE WHEN p1_price < p1_open THEN 100.0 ELSE 0 END), 4) AS pct_shortened FROM j GROUP BY season""",
    "forecast price closing opening",
)
def market_open_vs_close(spark, d):
    rows = last_capture(price(spark, d)).join(first_capture(price(spark, d)), "match_id").join(forecast(spark, d).select("match_id", "season"), "match_id")
    short = F.when(F.col("p1_price") < F.col("p1_open"), 100.0).otherwise(0.0)
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg(F.col("p1_price") - F.col("p1_open")), 6).alias("mean_move"), F.round(F.avg(short), 4).alias("pct_shortened"))


@query(
    "market_best_price",
    """SELECT match_id, max(p1_price) AS best_p1, max(p2_price) AS best_p2, round(median(p1_price), 6) AS median_p1, count(DISTINCT book) AS books,
  count(*) FILTER (WHERE p1_price > 1.15 * m) AS stale FROM (SELECT *, median(p1_price) OVER (PARTITION BY match_id) AS m FROM price) GROUP BY match_id HAVING count(DISTINCT book) > 1""",
    "price",
)
def market_best_price(spark, d):
    """The best price of each side, the median, and how many quotes stand 15 percent above it."""
    rows = price(spark, d).groupBy("match_id").agg(
        F.max("p1_price").alias("best_p1"), F.max("p2_price").alias("best_p2"), F.median("p1_price").alias("m"), F.countDistinct("book").alias("books"), F.collect_list("p1_price").alias("all")
    )
    stale = F.size(F.filter("all", lambda x: x > 1.15 * F.col("m"))).cast("long")
    return rows.filter("books > 1").select("match_id", "best_p1", "best_p2", F.round("m", 6).alias("median_p1"), "books", stale.alias("stale"))


@query(
    "market_consensus",
    """WITH s AS (SELECT match_id, ln, book, max(p1_price) AS o1, max(p2_price) AS o2 FROM price GROUP BY ALL),
v AS (SELECT *, 1 / o1 + 1 / o2 AS t FROM s)
SELECT match_id, ln, round(avg(CASE WHEN t >= 1 THEN 1 / o1 - (t - 1) / 2 ELSE (1 / o1) / t END), 6) AS p_market, count(DISTINCT book) AS books, round(median(t), 6) AS overround FROM v GROUP BY match_id, ln""",
    "price",
)
def market_consensus(spark, d):
    """Per rung: sides pivoted by conditional maxima, the margin removed per book, then averaged over books."""
    books = price(spark, d).groupBy("match_id", "ln", "book").agg(F.max("p1_price").alias("o1"), F.max("p2_price").alias("o2"))
    p = mk.shin(F.col("o1"), F.col("o2"))
    return books.groupBy("match_id", "ln").agg(
        F.round(F.avg(p), 6).alias("p_market"), F.countDistinct("book").alias("books"), F.round(F.median(mk.overround(F.col("o1"), F.col("o2"))), 6).alias("overround")
    )


@query(
    "market_synthetic_line",
    """WITH r AS (SELECT season, surface, y, line, pred FROM (SELECT season, surface, o_totalprice / 1000 AS y, o_totalprice / 1000 * 0.9 + 10 AS pred,
  avg(o_totalprice / 1000) OVER w AS line, count(*) OVER w AS n FROM (SELECT f.*, o.o_totalprice FROM forecast f JOIN orders o ON o.o_orderkey = f.match_id)
  WINDOW w AS (PARTITION BY surface ORDER BY play_ts, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 50),
b AS (SELECT *, CASE WHEN pred > line THEN CASE WHEN y > line THEN 0.909091 ELSE -1.0 END ELSE CASE WHEN y < line THEN 0.909091 ELSE -1.0 END END AS unit FROM r WHERE abs(pred - line) > 5)
SELECT surface, count(*) AS bets, round(avg(unit) * 100, 4) AS roi_pct, round(avg(abs(line - y)), 4) AS line_mae FROM b GROUP BY surface""",
    "forecast",
)
def market_synthetic_line(spark, d):
    """Bets against the mean of all earlier results of the segment, at a fixed price."""
    from ..operators.ordering import running_totals
    from .views import table

    y = F.col("o_totalprice") / 1000
    rows = forecast(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), "o_totalprice"), "match_id")
    rows = running_totals(rows.select("play_ts", "match_id", "surface", y.alias("y")), ["play_ts", "match_id"], {"n": F.lit(1), "t": F.col("y")}, ["surface"]).filter("n >= 50")
    rows = rows.withColumn("pred", F.col("y") * 0.9 + 10).withColumn("line", F.col("t") / F.col("n"))
    rows = rows.filter(F.abs(F.col("pred") - F.col("line")) > 5)
    won = F.when(F.col("pred") > F.col("line"), F.col("y") > F.col("line")).otherwise(F.col("y") < F.col("line"))
    return rows.groupBy("surface").agg(
        F.count("*").alias("bets"), F.round(F.avg(F.when(won, 0.909091).otherwise(-1.0)) * 100, 4).alias("roi_pct"), F.round(F.avg(F.abs(F.col("line") - F.col("y"))), 4).alias("line_mae")
    )


U = "CAST('0x' || substr(md5(concat_ws('|', '7', CAST(r AS VARCHAR), CAST(match_id AS VARCHAR))), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496"
WEIGHT = " + ".join(f"(CASE WHEN u >= {c!r}e0 THEN 1 ELSE 0 END)" for c in __import__("itertools").accumulate(__import__("math").exp(-1) / __import__("math").factorial(k) for k in range(8)))


@query(
    "market_bootstrap",
    f"""WITH {BETS}, c AS (SELECT match_id, sum(unit) AS v, count(*) AS n FROM settled GROUP BY match_id),
x AS (SELECT r, v, n, {U} AS u FROM c, range(1, 41) t(r)), y AS (SELECT r, v, n, {WEIGHT} AS w FROM x)
SELECT r AS replicate, round(sum(w * v) / sum(w * n), 6) AS estimate FROM y GROUP BY r""",
    MARKET,
)
def market_bootstrap(spark, d):
    """A clustered bootstrap of the return: clusters are summed before they are replicated."""
    rows = betting.with_bets(priced(spark, d)).groupBy("match_id").agg(F.sum(betting.profit()).alias("v"), F.count("*").alias("n"))
    return betting.bootstrap(rows, "match_id", "v", "n", 40)


@query(
    "market_blend_sweep",
    f"""WITH s AS (SELECT y_win, ln(p_win / (1 - p_win)) AS a, ln({SHIN} / (1 - {SHIN})) AS b FROM priced), x AS (SELECT w, y_win, 1 / (1 + exp(-(w / 10 * a + (1 - w / 10) * b))) AS p FROM s, range(0, 11) t(w))
SELECT CAST(w AS BIGINT) AS weight, round(-avg(CASE WHEN y_win = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM x GROUP BY w""",
    MARKET,
)
def market_blend_sweep(spark, d):
    """Log loss of a logit blend of model and market for eleven weights, in one pass."""
    rows = priced(spark, d).select("y_win", mk.logit(F.col("p_win")).alias("a"), mk.logit(mk.shin(F.col("p1_price"), F.col("p2_price"))).alias("b"))
    rows = rows.withColumn("weight", F.explode(F.sequence(F.lit(0), F.lit(10))))
    w = F.col("weight") / 10
    p = mk.sigmoid(w * F.col("a") + (1 - w) * F.col("b"))
    return rows.groupBy(F.col("weight").cast("long").alias("weight")).agg(F.round(mk.log_loss(F.col("y_win"), p), 6).alias("log_loss"))


@query(
    "market_walk_forward_blend",
    f"""WITH s AS (SELECT season, y_win, ln(p_win / (1 - p_win)) AS a, ln({SHIN} / (1 - {SHIN})) AS b FROM priced), x AS (SELECT season, w, y_win, 1 / (1 + exp(-(w / 10 * a + (1 - w / 10) * b))) AS p FROM s, range(0, 11) t(w)),
g AS (SELECT season, w, count(*) AS n, -sum(CASE WHEN y_win = 1 THEN ln(p) ELSE ln(1 - p) END) AS loss FROM x GROUP BY season, w),
c AS (SELECT *, sum(loss) OVER o AS past, CAST(sum(n) OVER o AS BIGINT) AS before FROM g WINDOW o AS (PARTITION BY w ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT season, arg_min(w, (round(past / before, 9), w)) AS weight, max(before) AS trained_on FROM c WHERE before >= 100 GROUP BY season)
SELECT b.season, m.n, trained_on, CAST(weight AS BIGINT) AS weight, round(e.loss / m.n, 6) AS blended, round(m.loss / m.n, 6) AS model, round(k.loss / m.n, 6) AS market
FROM b JOIN g e ON e.season = b.season AND e.w = weight JOIN g m ON m.season = b.season AND m.w = 10 JOIN g k ON k.season = b.season AND k.w = 0""",
    MARKET,
)
def market_walk_forward_blend(spark, d):
    """Each season scored by the blend that was best in the seasons before it, beside the model and the market alone."""
    rows = priced(spark, d).select("season", "y_win", mk.logit(F.col("p_win")).alias("a"), mk.logit(mk.shin(F.col("p1_price"), F.col("p2_price"))).alias("b"))
    w = F.col("weight") / 10
    rows = rows.withColumn("weight", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("p", mk.sigmoid(w * F.col("a") + (1 - w) * F.col("b")))
    by = written(rows.groupBy("season", F.col("weight").cast("long").alias("weight")).agg(F.count("*").alias("n"), F.sum(-F.ln(F.when(F.col("y_win") == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("loss")), "blends")
    of = lambda weight, name: by.filter(F.col("weight") == weight).select("season", F.round(F.col("loss") / F.col("n"), 6).alias(name))
    best = betting.expanding_best(by).join(by, ["season", "weight"]).select("season", "n", "trained_on", "weight", F.round(F.col("loss") / F.col("n"), 6).alias("blended"))
    return best.join(of(10, "model"), "season").join(of(0, "market"), "season")


@query(
    "market_upcoming_value",
    f"""WITH l AS (SELECT max(play_ts) AS last FROM forecast), u AS (SELECT p.* FROM priced p, l WHERE p.play_ts >= l.last - INTERVAL 30 DAY)
SELECT match_id, round({SHIN}, 6) AS p_market, round(p_win * p1_price - 1, 6) AS ev1, round((1 - p_win) * p2_price - 1, 6) AS ev2,
  round(greatest(0, least(0.05, (p_win * (p1_price - 1) - (1 - p_win)) / (p1_price - 1))), 6) AS stake1 FROM u""",
    MARKET,
)
def market_upcoming_value(spark, d):
    """Expected value and stake of the fixtures of the last 30 days, by dates and not by digits of dates."""
    rows = priced(spark, d)
    last = forecast(spark, d).agg(F.max("play_ts")).first()[0]
    rows = rows.filter(F.col("play_ts") >= F.lit(last) - F.expr("INTERVAL 30 DAYS"))
    p, o1, o2 = F.col("p_win"), F.col("p1_price"), F.col("p2_price")
    return rows.select(
        "match_id", F.round(mk.shin(o1, o2), 6).alias("p_market"), F.round(mk.expected_value(p, o1), 6).alias("ev1"), F.round(mk.expected_value(1 - p, o2), 6).alias("ev2"), F.round(mk.kelly(p, o1), 6).alias("stake1")
    )


FIXTURE_DAYS = 60
FIXTURES_SQL = f"""WITH q AS (SELECT *, k1 + 1 - ln % 2 AS a, k1 + ln % 2 AS b FROM price WHERE captured_at >= (SELECT max(captured_at) FROM price) - INTERVAL {FIXTURE_DAYS} DAY),
fn AS (SELECT p_partkey, {FEED_NAME} AS name FROM part),
f AS (SELECT *, 1 / p1_price + 1 / p2_price AS overround FROM (SELECT q.*, x.name AS p1_name, y.name AS p2_name,
    row_number() OVER (PARTITION BY least(x.name, y.name), greatest(x.name, y.name) ORDER BY captured_at DESC, match_id DESC, ln DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) AS place
  FROM q JOIN fn x ON x.p_partkey = a JOIN fn y ON y.p_partkey = b WHERE x.name IS NOT NULL AND y.name IS NOT NULL) WHERE place = 1),
p0 AS (SELECT p_partkey AS player_id, p_size AS seen, {PLAIN.format("p_name")} AS plain FROM part), pk AS (SELECT player_id, seen, plain, {KEYED.format("p0")}),
x AS (SELECT 'n' || plain AS key, player_id, seen FROM pk WHERE plain <> '' UNION ALL SELECT 's' || skey, player_id, seen FROM pk WHERE skey <> ''), ix AS (SELECT key, arg_max(player_id, (seen, -player_id)) AS player_id FROM x GROUP BY key),
a0 AS (SELECT name, {PLAIN.format("name")} AS plain FROM (SELECT p1_name AS name FROM f UNION SELECT p2_name FROM f)), ak AS (SELECT name, plain, l, {KEYED.format("a0")}),
r AS (SELECT name, 0 AS level, 'n' || plain AS key FROM ak UNION ALL SELECT name, 1, 's' || skey FROM ak UNION ALL SELECT name, k, 's' || l[k] || '|' || left(l[1], 1) FROM (SELECT name, l, unnest(range(2, n + 1)) AS k FROM ak WHERE n > 2)),
b AS (SELECT name, arg_min(player_id, level) AS player_id FROM r JOIN ix USING (key) WHERE length(key) > 1 GROUP BY name),
m AS (SELECT f.*, u.player_id AS p1_id, v.player_id AS p2_id, 1 / (1 + pow(10, 8 * (t.p_size - s.p_size) / 400e0)) AS pm, {SHIN} AS pk FROM f
  LEFT JOIN b u ON u.name = p1_name LEFT JOIN b v ON v.name = p2_name LEFT JOIN part s ON s.p_partkey = u.player_id LEFT JOIN part t ON t.p_partkey = v.player_id),
e AS (SELECT *, CASE WHEN pm IS NOT NULL THEN round(pm * p1_price - 1, 9) >= round((1 - pm) * p2_price - 1, 9) END AS one FROM m),
z AS (SELECT *, CASE WHEN one THEN p1_price WHEN NOT one THEN p2_price END AS price, CASE WHEN one THEN pm WHEN NOT one THEN 1 - pm END AS p FROM e)
SELECT p1_name, p2_name, p1_id, p2_id, CASE WHEN one THEN p1_name WHEN NOT one THEN p2_name END AS pick, round(price, 6) AS price, round(p, 6) AS p_model, round(CASE WHEN one THEN pk WHEN NOT one THEN 1 - pk END, 6) AS p_market, round(p * price - 1, 6) AS ev,
  CASE WHEN p IS NOT NULL THEN round(greatest(0, least(0.05, coalesce((p * (price - 1) - (1 - p)) / nullif(greatest(price - 1, 0), 0), 0))), 6) END AS stake, CASE WHEN pm IS NULL THEN 'unresolved' WHEN round(p * price - 1, 9) >= 0.05 THEN 'bet' ELSE 'no edge' END AS status FROM z"""


@query("market_fixture_picks", FIXTURES_SQL, "price")
def market_fixture_picks(spark, d):
    """Fixtures listed in the last FIXTURE_DAYS days, one row a pairing from its last listing, its feed names resolved to players, with the side to back, its price, chance, value and stake.

    Fixtures of which a name resolves to nobody stay, without a pick.
    """
    parts, quotes = table(spark, d, "part"), price(spark, d)
    last = quotes.agg(F.max("captured_at")).first()[0]
    feed = parts.select("p_partkey", F.expr(FEED_NAME).alias("name"))
    of = lambda key, name: feed.select(F.col("p_partkey").alias(key), F.col("name").alias(name))
    listed = quotes.filter(F.col("captured_at") >= F.lit(last) - F.expr(f"INTERVAL {FIXTURE_DAYS} DAYS")).withColumn("a", F.col("k1") + 1 - F.col("ln") % 2).withColumn("b", F.col("k1") + F.col("ln") % 2)
    listed = listed.join(of("a", "p1_name"), "a").join(of("b", "p2_name"), "b")
    fixtures = written(betting.freshest_pairings(listed, "p1_name", "p2_name", "captured_at", "match_id", "ln", *CAPTURE_ORDER), "fixtures")
    players = parts.select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.col("p_size").alias("last_seen"))
    found = rel.resolved(fixtures.select(F.explode(F.array("p1_name", "p2_name")).alias("name")).distinct(), players).select("name", "player_id")
    rated = written(found.join(players.select("player_id", (F.col("last_seen") * 8).cast("double").alias("rating")), "player_id", "left").select("name", "player_id", "rating"), "players")
    side = lambda i: rated.select(F.col("name").alias(f"p{i}_name"), F.col("player_id").alias(f"p{i}_id"), F.col("rating").alias(f"_r{i}"))
    rows = fixtures.join(side(1), "p1_name").join(side(2), "p2_name").withColumn("p_model", ratings.expected(F.col("_r1"), F.col("_r2")))
    rows = betting.with_picks(rows)
    first, market = F.col("side") == 1, mk.shin(F.col("p1_price"), F.col("p2_price"))
    return rows.select(
        "p1_name", "p2_name", "p1_id", "p2_id", F.when(first, F.col("p1_name")).when(~first, F.col("p2_name")).alias("pick"), F.round("price", 6).alias("price"), F.round("p_side", 6).alias("p_model"),
        F.round(F.when(first, market).when(~first, 1 - market), 6).alias("p_market"), F.round("ev", 6).alias("ev"), F.round("stake", 6).alias("stake"),
        F.when(F.col("p_model").isNull(), "unresolved").when(F.round("ev", 9) >= 0.05, "bet").otherwise("no edge").alias("status"),
    )
