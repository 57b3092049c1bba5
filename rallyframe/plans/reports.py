"""Queries that put results side by side: against lines and chains, by section, over a season, with intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..functions import probability as prob
from ..operators import betting, metrics, models, ratings
from ..operators.ordering import quantiles
from ..session import written
from .flagship import ELO_STEPS
from .ladders import RUNGS, rungs
from .models import inputs
from .registry import query
from .scores import MARKET, SHIN, WEIGHT, U
from .values import pooled
from .views import forecast, priced, table

LOSS = "CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END"
FIT_BEFORE = 1997


@query(
    "report_lines",
    f"""WITH {RUNGS}, b AS (SELECT f.match_id, season, f.match_id % 2 AS fmt, CASE WHEN f.match_id % 3 = 0 THEN 'challenger' ELSE 'main tour' END AS tier, o_totalprice / 1000 AS actual, o_totalprice / 2000 + player_id % 100 AS pred FROM forecast f JOIN orders ON o_orderkey = f.match_id),
z AS (SELECT * FROM b WHERE season < {FIT_BEFORE}), q AS (SELECT fmt, quantile_cont(pred, [1/6, 2/6, 3/6, 4/6, 5/6]) AS edges FROM z GROUP BY fmt),
zc AS (SELECT z.*, len(list_filter(edges, lambda e: e < pred)) AS cell FROM z JOIN q USING (fmt)), nc AS (SELECT fmt, cell, count(*) AS n FROM zc GROUP BY ALL), ng AS (SELECT fmt, count(*) AS n FROM zc GROUP BY ALL),
s AS (SELECT b.*, ln * 60e0 AS line, g.p AS p_market, t, len(list_filter(edges, lambda e: e < pred)) AS cell FROM b JOIN g USING (match_id) JOIN q USING (fmt) WHERE season >= {FIT_BEFORE}),
a AS (SELECT s.*, line - pred AS v, CASE WHEN nc.n >= 500 THEN s.fmt || '/' || s.cell WHEN ng.n >= 500 THEN s.fmt || '' ELSE '*' END AS pool FROM s LEFT JOIN nc ON nc.fmt = s.fmt AND nc.cell = s.cell LEFT JOIN ng ON ng.fmt = s.fmt),
e AS (SELECT unnest([fmt || '/' || cell, fmt || '', '*']) AS pool, actual - pred AS v FROM zc), sz AS (SELECT pool, count(*) AS size FROM e GROUP BY pool),
k AS (SELECT pool, v, sum(count(*)) OVER (PARTITION BY pool ORDER BY v) AS below FROM e GROUP BY pool, v),
x AS (SELECT a.*, least(1 - 1e-6, greatest(1e-6, 1 - coalesce(k.below, 0) / sz.size)) AS p_over, CASE WHEN actual > line THEN 1 ELSE 0 END AS y FROM a ASOF LEFT JOIN k ON a.pool = k.pool AND a.v >= k.v JOIN sz ON sz.pool = a.pool WHERE actual <> line)
SELECT tier, count(*) AS n, count(DISTINCT match_id) AS matches, round(median(t), 6) AS overround, round(avg(CASE WHEN y = 1 THEN -ln(p_over) ELSE -ln(1 - p_over) END), 5) AS model_loss,
  round(avg(CASE WHEN y = 1 THEN -ln(p_market) ELSE -ln(1 - p_market) END), 5) AS market_loss FROM x GROUP BY tier""",
    "forecast price",
)
def report_lines(spark, d):
    """The model's chance to pass a line, from residuals of earlier seasons, against the market's, by tier; pushes are left out."""
    out = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_totalprice") / 1000).alias("actual"))
    base = forecast(spark, d).join(out, "match_id").select(
        "match_id", "season", (F.col("match_id") % 2).alias("fmt"), F.when(F.col("match_id") % 3 == 0, "challenger").otherwise("main tour").alias("tier"), "actual", (F.col("actual") / 2 + F.col("player_id") % 100).alias("pred")
    )
    asked = base.filter(F.col("season") >= FIT_BEFORE).join(rungs(spark, d), "match_id").withColumn("line", F.col("ln") * 60.0)
    rows = written(models.residual_chance(asked, "fmt", "pred", "actual", "line", fit=base.filter(F.col("season") < FIT_BEFORE)).filter("actual <> line"), "lines")
    y = F.when(F.col("actual") > F.col("line"), 1).otherwise(0)
    middle = quantiles(rows, "t", {"overround": 0.5}, ["tier"]).withColumn("overround", F.round("overround", 6))
    found = rows.groupBy("tier").agg(
        F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"), F.round(mk.log_loss(y, F.col("p_over")), 5).alias("model_loss"), F.round(mk.log_loss(y, F.col("p")), 5).alias("market_loss")
    )
    return found.join(middle, "tier", "left")


@query(
    "report_movement",
    f"""{ELO_STEPS}, h AS (SELECT median(match_id) AS h FROM contest), s AS (SELECT m.pool, m.match_id, c.winner_id, c.loser_id, e.r AS w, e.r2 AS l FROM h, m JOIN contest c USING (match_id) JOIN e ON e.kind = 'm' AND e.id = CAST(m.match_id AS VARCHAR) WHERE m.match_id > h),
x AS (SELECT pool, match_id, winner_id AS player_id, w AS r0, 1 AS won FROM s UNION ALL SELECT pool, match_id, loser_id, l, 0 FROM s)
SELECT x.pool, x.player_id, round(arg_min(r0, match_id), 6) AS elo_start, round(max(p.r) - arg_min(r0, match_id), 6) + 0 AS movement, CAST(sum(won) AS BIGINT) AS season_w, CAST(sum(1 - won) AS BIGINT) AS season_l
FROM x JOIN e p ON p.kind = 'p' AND p.id = x.pool || '|' || x.player_id GROUP BY x.pool, x.player_id""",
    "contest",
)
def report_movement(spark, d):
    """How far each player's rating moved since the season's first match, from the state before it, with wins and losses."""
    rows = pooled(spark, d)
    opener = quantiles(rows, "match_id", {"half": 0.5}).first()[0]
    earlier, season = rows.filter(F.col("match_id") <= opener), rows.filter(F.col("match_id") > opener)
    before = written(ratings.elo_state(earlier, ["pool"]), "opener")
    now = ratings.elo_state(season, ["pool"], state=before).filter("scope is null").select("pool", "player_id", F.col("rating").alias("now"))
    sides = F.explode(F.array(F.struct(F.col("winner_id").alias("player_id"), F.lit(1).alias("won")), F.struct(F.col("loser_id").alias("player_id"), F.lit(0).alias("won"))))
    tally = season.filter("not walkover").select("pool", "day", sides.alias("s")).groupBy("pool", "s.player_id").agg(F.sum("s.won").alias("season_w"), F.sum(1 - F.col("s.won")).alias("season_l"), F.min("day").alias("day"))
    known = before.filter("scope is null").select("pool", "player_id", "rating", "last_day")
    joined = tally.join(now, ["pool", "player_id"]).join(known, ["pool", "player_id"], "left")
    start = F.coalesce(ratings.drifted(F.col("rating"), F.col("day") - F.col("last_day")), F.lit(ratings.EloRule().base))
    return joined.select("pool", "player_id", F.round(start, 6).alias("elo_start"), (F.round(F.col("now") - start, 6) + 0.0).alias("movement"), "season_w", "season_l")


BAND = "CASE WHEN level IN ('MACHINERY', 'BUILDING') THEN 'main' WHEN level = 'AUTOMOBILE' THEN 'challenger' ELSE 'team' END"
FEED = "CASE WHEN s_suppkey % 3 = 0 THEN concat('Grand Open - ', n_name) WHEN s_suppkey % 3 = 1 THEN concat(lower(n_name), ' Challenger') ELSE concat(substr(n_name, 2), ' Open') END"


@query(
    "report_city_history",
    f"""WITH r AS (SELECT n_name AS name, o_orderpriority AS surface, c_mktsegment AS level, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
h AS (SELECT name, surface, level, {BAND} AS band, count(*) AS n, max(o_orderdate) AS held FROM r GROUP BY ALL),
f AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'main' ELSE 'challenger' END AS band, lower(trim(regexp_replace(string_split({FEED}, ' - ')[-1], ' Challenger| Open', '', 'g'))) AS tail FROM supplier JOIN nation ON n_nationkey = s_nationkey),
j AS (SELECT f.id, f.tail, h.surface, h.level, row_number() OVER (PARTITION BY id ORDER BY lower(name) = tail DESC, held DESC, n DESC, surface DESC, level DESC) AS k FROM f LEFT JOIN h ON h.band = f.band AND length(tail) >= 4 AND contains(lower(name), tail))
SELECT id, tail, surface, level FROM j WHERE k = 1""",
)
def report_city_history(spark, d):
    """Surface and level of a feed's tournament from the latest event of its city within the feed's tier.

    A city's whole name goes first, then one that contains the feed's; pieces of the distinct names are the keys of that join.
    """
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"), F.col("c_mktsegment").alias("level"))
    held = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("name", F.col("o_orderpriority").alias("surface"), "level").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("held"))
    best = held.groupBy(F.lower("name").alias("name"), F.expr(BAND).alias("band")).agg(F.max(F.struct("held", "n", "surface", "level")).alias("best"))
    size = F.length("name")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), size - 3), lambda i: F.transform(F.sequence(F.lit(4), size - i + 1), lambda n: F.substr(F.col("name"), i, n))))
    keyed = best.filter(size >= 4).select("band", "name", "best", F.explode(F.array_distinct(pieces)).alias("tail"))
    city = F.substring_index(F.expr(FEED), " - ", -1)
    feed = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    feed = feed.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "main").otherwise("challenger").alias("band"), F.lower(F.trim(F.regexp_replace(city, " Challenger| Open", ""))).alias("tail"))
    found = feed.join(keyed, ["band", "tail"], "left").withColumn("b", F.struct((F.col("name") == F.col("tail")).alias("whole"), "best.*"))
    return found.groupBy("id", "tail").agg(F.max("b").alias("b")).select("id", "tail", "b.surface", "b.level")


@query(
    "report_paired_interval",
    f"""WITH c AS (SELECT match_id, CASE WHEN y_win = 1 THEN ln({SHIN}) - ln(p_win) ELSE ln(1 - {SHIN}) - ln(1 - p_win) END AS v, 1 AS n FROM priced),
x AS (SELECT r, v, n, {U} AS u FROM c, range(1, 101) t(r)), y AS (SELECT r, v, n, {WEIGHT} AS w FROM x), z AS (SELECT r, round(sum(w * v) / sum(w * n), 6) AS e FROM y GROUP BY r)
SELECT count(*) AS replicates, round(quantile_cont(e, 0.025), 5) AS low, round(quantile_cont(e, 0.975), 5) AS high, round(avg(CASE WHEN e < 0 THEN 1e0 ELSE 0 END), 6) AS p_better FROM z""",
    MARKET,
)
def report_paired_interval(spark, d):
    """A 95 % interval of the mean difference in log loss between model and market on the same matches, and the share of replicates in which the model is better."""
    y, p, q = F.col("y_win") == 1, F.col("p_win"), mk.shin(F.col("p1_price"), F.col("p2_price"))
    gap = F.when(y, F.ln(q) - F.ln(p)).otherwise(F.ln(1 - q) - F.ln(1 - p))
    estimates = betting.bootstrap(priced(spark, d).select("match_id", gap.alias("v"), F.lit(1).alias("n")), "match_id", "v", "n", 100)
    return estimates.agg(
        F.count("*").alias("replicates"), F.round(F.percentile("estimate", 0.025), 5).alias("low"), F.round(F.percentile("estimate", 0.975), 5).alias("high"), F.round(F.avg(F.when(F.col("estimate") < 0, 1.0).otherwise(0.0)), 6).alias("p_better")
    )


@query(
    "report_rank_agreement",
    f"""WITH s AS (SELECT season, p_win AS a, round({SHIN}, 9) AS b FROM priced), r AS (SELECT season, rank() OVER (PARTITION BY season ORDER BY a) + (count(*) OVER (PARTITION BY season, a) - 1) / 2 AS ra,
rank() OVER (PARTITION BY season ORDER BY b) + (count(*) OVER (PARTITION BY season, b) - 1) / 2 AS rb FROM s) SELECT season, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY season""",
    MARKET,
)
def report_rank_agreement(spark, d):
    """Rank correlation of model and market by season; ranks come from counts of distinct values, so a season is not one task."""
    rows = priced(spark, d).select("season", F.col("p_win").alias("a"), F.round(mk.shin(F.col("p1_price"), F.col("p2_price")), 9).alias("b"))
    ranked = metrics.ranked(metrics.ranked(rows, "a", ["season"], "ra"), "b", ["season"], "rb")
    return ranked.groupBy("season").agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


@query(
    "report_sections",
    f"""WITH m AS (SELECT 'priced' AS section, 'model' AS name, y_win, p_win FROM priced UNION ALL SELECT 'priced', 'market', y_win, {SHIN} FROM priced UNION ALL SELECT 'all', 'model', y_win, p_win FROM forecast
UNION ALL SELECT 'surface', surface, y_win, p_win FROM forecast UNION ALL SELECT 'season', CAST(season AS VARCHAR), y_win, p_win FROM forecast),
b AS (SELECT *, CASE WHEN (side = 1) = (y_win = 1) THEN CASE WHEN side = 1 THEN p1_price ELSE p2_price END - 1 ELSE -1e0 END AS unit FROM
 (SELECT *, CASE WHEN p_win * p1_price - 1 >= (1 - p_win) * p2_price - 1 THEN 1 ELSE 2 END AS side, greatest(p_win * p1_price - 1, (1 - p_win) * p2_price - 1) AS ev FROM priced))
SELECT section, name, count(*) AS n, round(-avg(CASE WHEN y_win = 1 THEN ln(p_win) ELSE ln(1 - p_win) END), 6) AS log_loss, round(avg((p_win - y_win) * (p_win - y_win)), 6) AS brier, NULL::DOUBLE AS roi_pct FROM m GROUP BY section, name
UNION ALL SELECT 'returns', 'edge ' || e, count(*), NULL, NULL, round(avg(unit) * 100, 4) FROM b, (VALUES ('0.00', 0e0), ('0.03', 3e-2), ('0.05', 5e-2), ('0.10', 1e-1)) t(e, x) WHERE ev > x GROUP BY e""",
    MARKET,
)
def report_sections(spark, d):
    """The report in rows: all matches, surfaces and seasons in one pass, model against market where there is a price, returns by edge in one pass."""
    scores = [F.count("*").alias("n"), F.round(mk.log_loss(F.col("y_win"), F.col("p_win")), 6).alias("log_loss"), F.round(F.avg((F.col("p_win") - F.col("y_win")) ** 2), 6).alias("brier")]
    cells = forecast(spark, d).groupingSets([[], ["surface"], ["season"]], "surface", "season").agg(F.grouping_id().alias("g"), *scores)
    section = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "surface").otherwise("season")
    whole = cells.select(section.alias("section"), F.coalesce("surface", F.col("season").cast("string"), F.lit("model")).alias("name"), "n", "log_loss", "brier")
    rows = priced(spark, d)
    both = rows.select("y_win", F.explode(F.create_map(F.lit("model"), F.col("p_win"), F.lit("market"), mk.shin(F.col("p1_price"), F.col("p2_price")))).alias("name", "p_win"))
    subset = both.groupBy("name").agg(*scores).select(F.lit("priced").alias("section"), "name", "n", "log_loss", "brier")
    edges = F.create_map(*[F.lit(x) for e in ("0.00", "0.03", "0.05", "0.10") for x in (f"edge {e}", float(e))])
    bets = betting.with_bets(rows, edge=0.0).select("ev", "won", "bet_price", F.explode(edges).alias("name", "edge")).filter("ev > edge")
    returns = bets.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg(betting.profit()) * 100, 4).alias("roi_pct")).withColumn("section", F.lit("returns"))
    return whole.unionByName(subset).unionByName(returns, allowMissingColumns=True).select("section", "name", "n", "log_loss", "brier", "roi_pct")


SET = "(0.35e0 + 0.3e0 * p_win)"


@query(
    "report_chain",
    f"""WITH b AS (SELECT y_win AS y, p_win AS m, CASE WHEN match_id % 4 = 0 THEN pow({SET}, 3) * (10 - 15 * {SET} + 6 * {SET} ** 2) ELSE {SET} ** 2 * (3 - 2 * {SET}) END AS c, match_id FROM forecast),
z AS (SELECT *, ln(c / (1 - c)) AS lc, ln(m / (1 - m)) AS lm FROM b),
l AS (SELECT y, match_id, unnest(['chain', 'model', 'logit 0.25', 'logit 0.50', 'logit 0.75', 'mean']) AS name, unnest([c, m, 1 / (1 + exp(-(0.25e0 * lc + 0.75e0 * lm))), 1 / (1 + exp(-(0.5e0 * lc + 0.5e0 * lm))), 1 / (1 + exp(-(0.75e0 * lc + 0.25e0 * lm))), (c + m) / 2]) AS p FROM z),
s AS (SELECT name, y, p, unnest(['all', CASE WHEN match_id % 4 = 0 THEN 'best of 5' ELSE 'best of 3' END, CASE WHEN match_id % 3 = 0 THEN 'challenger' ELSE 'main tour' END]) AS split FROM l)
SELECT split, name, count(*) AS n, round(avg({LOSS}), 5) AS log_loss, round(avg((p - y) * (p - y)), 5) AS brier, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1e0 ELSE 0 END), 5) AS accuracy, (SELECT round(corr(c, m), 5) FROM z) AS correlation FROM s GROUP BY split, name HAVING count(*) >= 500""",
    "forecast",
)
def report_chain(spark, d):
    """The chain of sets against the model and their blends, over all matches and by format and tier; small splits are left out."""
    m, k, s = F.col("p_win"), F.col("match_id"), 0.35 + 0.3 * F.col("p_win")
    rows = forecast(spark, d).select("match_id", "y_win", "p_win", F.when(k % 4 == 0, prob.match(s, F.lit(5))).otherwise(prob.match(s, F.lit(3))).alias("c"))
    c = F.col("c")
    blends = {"chain": c, "model": m, **{f"logit {w:.2f}": mk.sigmoid(w * mk.logit(c) + (1 - w) * mk.logit(m)) for w in (0.25, 0.5, 0.75)}, "mean": (c + m) / 2}
    named = F.explode(F.create_map(*[x for n, v in blends.items() for x in (F.lit(n), v)])).alias("name", "p")
    splits = F.array(F.lit("all"), F.when(k % 4 == 0, "best of 5").otherwise("best of 3"), F.when(k % 3 == 0, "challenger").otherwise("main tour"))
    long = rows.select("y_win", splits.alias("s"), named).select("name", "y_win", "p", F.explode("s").alias("split"))
    y, p = F.col("y_win"), F.col("p")
    scores = long.groupBy("split", "name").agg(F.count("*").alias("n"), F.round(mk.log_loss(y, p), 5).alias("log_loss"), F.round(F.avg((p - y) ** 2), 5).alias("brier"), F.round(F.avg(F.when((p > 0.5) == (y == 1), 1.0).otherwise(0.0)), 5).alias("accuracy"))
    return scores.filter("n >= 500").join(rows.agg(F.round(F.corr("c", "p_win"), 5).alias("correlation")), F.lit(True), "left")


@query("model_family_share")
def model_family_share(spark, d):
    """The share of a boosted model's importance that each family of inputs has."""
    rows, features = models.with_indicators(inputs(spark, d), ["p_win", "market", "over"])
    weights = models.fitted(rows, features, "label", "gbt").stages[-1].featureImportances.toArray().tolist()
    families = F.array(*[F.struct(F.lit("margin" if f.startswith("over") else "chance").alias("family"), F.lit(w).alias("w")) for f, w in zip(features, weights, strict=True)])
    parts = rows.agg(F.count("*").alias("rows")).select("rows", F.explode(families).alias("x"))
    return parts.groupBy("rows", "x.family").agg(F.sum("x.w").alias("share"))
