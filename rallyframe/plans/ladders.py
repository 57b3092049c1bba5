"""Queries on ladders of lines, walks through unfinished draws and discovery of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..operators import bracket, form, metrics
from .brackets import ROUNDS, event_sql, one_event
from .registry import query
from .views import forecast, price, table

RUNGS = "c AS (SELECT match_id, ln, max(p1_price) AS p1, max(p2_price) AS p2 FROM price GROUP BY ALL), g AS (SELECT match_id, ln, (1 / p1) / (1 / p1 + 1 / p2) AS p, 1 / p1 + 1 / p2 AS t FROM c)"


def rungs(spark, d):
    wide = price(spark, d).groupBy("match_id", "ln").agg(F.max("p1_price").alias("p1"), F.max("p2_price").alias("p2"))
    return wide.select("match_id", "ln", mk.proportional(F.col("p1"), F.col("p2")).alias("p"), mk.overround(F.col("p1"), F.col("p2")).alias("t"))


@query(
    "ladder_orientation",
    f"""WITH {RUNGS}, r AS (SELECT *, rank() OVER (PARTITION BY match_id ORDER BY ln) + (count(*) OVER (PARTITION BY match_id, ln) - 1) / 2 AS a,
  rank() OVER (PARTITION BY match_id ORDER BY p) + (count(*) OVER (PARTITION BY match_id, p) - 1) / 2 AS b FROM g),
o AS (SELECT match_id, round(covar_pop(a, b), 6) AS s FROM r GROUP BY match_id HAVING count(*) >= 4 AND var_pop(a) > 0 AND var_pop(b) > 0)
SELECT match_id, CASE WHEN s < 0 THEN ln ELSE -ln END AS line, round(p, 6) AS p FROM g JOIN o USING (match_id)""",
    "price",
)
def ladder_orientation(spark, d):
    """Lines in the first side's frame by the ladder's direction; ladders of fewer than four rungs are left out."""
    rows = rungs(spark, d)
    way = metrics.spearman(rows, "ln", "p", ["match_id"]).filter("rho is not null").select("match_id", F.round("rho", 6).alias("rho"))
    return rows.join(way, "match_id").select("match_id", F.when(F.col("rho") < 0, F.col("ln")).otherwise(-F.col("ln")).alias("line"), F.round("p", 6).alias("p"))


@query(
    "ladder_settled",
    f"""WITH {RUNGS}, j AS (SELECT g.match_id, ln, season, o_totalprice / 60000 > ln AS over, greatest(1.01, least(50, 1 / (p * greatest(t, 1)))) AS price, least(0.95, p * 1.1) AS q FROM g JOIN forecast f USING (match_id) JOIN orders ON o_orderkey = g.match_id),
e AS (SELECT *, round(q * price - 1, 6) AS ev FROM j), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ev DESC, ln) AS k FROM e WHERE ev > 0.01) WHERE k = 1)
SELECT season, count(*) AS bets, round(avg(CASE WHEN over THEN price - 1 ELSE -1 END) * 100, 4) AS roi_pct, round(avg(1 / price), 6) AS breakeven FROM b GROUP BY season""",
    "forecast price",
)
def ladder_settled(spark, d):
    """One rung a match, that of the greatest expected value at a price made from the ladder's own chance; settled on the outcome."""
    out = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_totalprice") / 60000).alias("actual"))
    rows = rungs(spark, d).join(forecast(spark, d).select("match_id", "season"), "match_id").join(out, "match_id")
    bet = F.greatest(F.lit(1.01), F.least(F.lit(50.0), 1 / (F.col("p") * F.greatest("t", F.lit(1.0)))))
    rows = rows.select("match_id", "ln", "season", (F.col("actual") > F.col("ln")).alias("over"), bet.alias("price"), F.least(F.lit(0.95), F.col("p") * 1.1).alias("q"))
    rows = rows.withColumn("ev", F.round(mk.expected_value(F.col("q"), F.col("price")), 6)).filter("ev > 0.01")
    one = form.first_by(rows, ["match_id"], -F.col("ev"), F.col("ln"))
    unit = F.when(F.col("over"), F.col("price") - 1).otherwise(-1.0)
    return one.groupBy("season").agg(F.count("*").alias("bets"), F.round(F.avg(unit) * 100, 4).alias("roi_pct"), F.round(F.avg(1 / F.col("price")), 6).alias("breakeven"))


@query(
    "event_discovery",
    """SELECT o_custkey, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, count(*) AS fixtures, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS kinds,
  CASE WHEN max(o_totalprice) > 400000 THEN 1 WHEN max(o_totalprice) > 200000 THEN 2 ELSE 3 END AS tier FROM orders GROUP BY o_custkey HAVING count(*) >= 4""",
)
def event_discovery(spark, d):
    """Events with their extent, kinds and tier, for a list in tier order."""
    events = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"), F.count("*").alias("fixtures"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("kinds"), F.max("o_totalprice").alias("m")
    )
    return events.filter("fixtures >= 4").withColumn("tier", F.when(F.col("m") > 400000, 1).when(F.col("m") > 200000, 2).otherwise(3)).drop("m")


@query(
    "bracket_walk",
    event_sql(
        "SELECT draw_id, CAST(coalesce(max(round), 0) AS BIGINT) AS rounds, count(round) AS ties FROM full_ids LEFT JOIN (SELECT k.* FROM k JOIN f USING (draw_id) WHERE round <= last) USING (draw_id) GROUP BY draw_id",
        "k AS (SELECT * FROM results WHERE NOT (round >= 2 AND (draw_id + 3 * block + round) % 5 = 0))",
        "c AS (SELECT draw_id, round, count(*) = any_value(ceil(size / pow(2, round))) AS done FROM k JOIN full_ids USING (draw_id) GROUP BY draw_id, round)",
        f"f AS (SELECT g.draw_id, coalesce(min(CASE WHEN NOT coalesce(done, false) THEN r END), {ROUNDS + 1}) - 1 AS last FROM (SELECT draw_id, r FROM full_ids CROSS JOIN range(1, {ROUNDS + 1}) t(r)) g LEFT JOIN c ON c.draw_id = g.draw_id AND c.round = g.r GROUP BY g.draw_id)",
    ),
)
def bracket_walk(spark, d):
    """Draws in which some ties are still to be played: how many are pinned by complete rounds."""
    full, results = one_event(spark, d)
    open_ = results.filter(~((F.col("round") >= 2) & ((F.col("draw_id") + 3 * F.col("block") + F.col("round")) % 5 == 0)))
    pinned = bracket.complete_rounds(open_, full.groupBy("draw_id").agg(F.count("*").alias("size")))
    return full.select("draw_id").distinct().join(pinned.groupBy("draw_id").agg(F.max("round").alias("rounds"), F.count("*").alias("ties")), "draw_id", "left").select("draw_id", F.coalesce("rounds", F.lit(0)).cast("long").alias("rounds"), F.coalesce("ties", F.lit(0)).alias("ties"))


@query(
    "bracket_convention",
    event_sql(
        "SELECT draw_id, CASE WHEN bool_and(first) THEN 'first' WHEN bool_and(NOT first) THEN 'second' ELSE 'unknown' END AS convention FROM (SELECT draw_id, draw_id % 2 = 0 OR winner < loser AS first FROM results WHERE loser IS NOT NULL) GROUP BY draw_id"
    ),
)
def bracket_convention(spark, d):
    """Which side a feed lists winners on, by draw; draws of even number list them first here, the others by chance."""
    _, results = one_event(spark, d)
    results = results.filter("loser is not null")
    even = (F.col("draw_id") % 2 == 0) | (F.col("winner") < F.col("loser"))
    tie = F.concat_ws("/", "round", "block").alias("tie")
    listed = results.select("draw_id", tie, F.when(even, F.col("winner")).otherwise(F.col("loser")).alias("first_id"), F.when(even, F.col("loser")).otherwise(F.col("winner")).alias("second_id"))
    return bracket.winner_convention(listed, results.select("draw_id", tie, "winner"))


@query(
    "ladder_sides",
    f"""WITH {RUNGS}, j AS (SELECT g.match_id, ln, o_totalprice / 60000 > ln AS over, p, greatest(t, 1) AS t, least(0.95, greatest(0.05, p + CASE WHEN g.match_id % 2 = 0 THEN 8e-2 ELSE -8e-2 END)) AS q FROM g JOIN orders ON o_orderkey = g.match_id),
s AS (SELECT match_id, ln, side, CASE WHEN side = 'over' THEN q ELSE 1 - q END AS q, greatest(1.01, least(50, 1 / (CASE WHEN side = 'over' THEN p ELSE 1 - p END * t))) AS price, (side = 'over') = over AS won FROM j, (VALUES ('over'), ('under')) v(side)),
b AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ev DESC, ln, side) AS k FROM (SELECT *, round(q * price - 1, 6) AS ev FROM s) WHERE ev > 0.01)
SELECT rungs, side, count(*) AS bets, round(avg(CASE WHEN won THEN price - 1 ELSE -1 END) * 100, 4) AS roi_pct FROM (SELECT 'all' AS rungs, * FROM b UNION ALL SELECT 'best', * FROM b WHERE k = 1) GROUP BY rungs, side""",
    "price",
)
def ladder_sides(spark, d):
    """Bets on both sides of every rung, all of them and the best of each match."""
    out = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_totalprice") / 60000).alias("actual"))
    lean = F.when(F.col("match_id") % 2 == 0, 0.08).otherwise(-0.08)
    rows = rungs(spark, d).join(out, "match_id").withColumn("q", F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("p") + lean)))
    over = F.col("actual") > F.col("ln")
    side = lambda name, p, q, won: F.struct(F.lit(name).alias("side"), p.alias("p"), q.alias("q"), won.alias("won"))
    long = rows.select("match_id", "ln", F.greatest("t", F.lit(1.0)).alias("t"), F.explode(F.array(side("over", F.col("p"), F.col("q"), over), side("under", 1 - F.col("p"), 1 - F.col("q"), ~over))).alias("s")).select("match_id", "ln", "t", "s.*")
    bets = long.withColumn("price", F.greatest(F.lit(1.01), F.least(F.lit(50.0), 1 / (F.col("p") * F.col("t"))))).withColumn("ev", F.round(mk.expected_value(F.col("q"), F.col("price")), 6)).filter("ev > 0.01")
    one = form.first_by(bets, ["match_id"], -F.col("ev"), F.col("ln"), F.col("side"))
    both = bets.withColumn("rungs", F.lit("all")).unionByName(one.withColumn("rungs", F.lit("best")))
    return both.groupBy("rungs", "side").agg(F.count("*").alias("bets"), F.round(F.avg(F.when(F.col("won"), F.col("price") - 1).otherwise(-1.0)) * 100, 4).alias("roi_pct"))
