"""Queries on names, scores, dates, scoring probabilities and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..functions import probability as prob
from ..functions import text as tx
from ..operators import ratings
from ..operators.ordering import quantiles
from ..session import written
from .registry import query
from .views import contest, forecast, table


#: Names of parts with capitals, accents, dots and single words among them.
NAME = """CASE p_partkey % 5 WHEN 0 THEN replace(replace(upper(p_name), 'A', 'Á'), 'O', 'Ǒ') WHEN 1 THEN replace(p_name, 'e', 'é-') WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN concat(p_name, ' J. K') ELSE concat('Ž. ', p_name, '.  x ') END"""
NAMED = f"""n AS (SELECT p_partkey, trim(regexp_replace(translate(lower(strip_accents({NAME})), '-.' || chr(39), '  '), '\\s+', ' ', 'g')) AS plain FROM part)"""


def named(spark, d):
    """Names with accents put in and taken out again: one pass through Arrow over the names."""
    return table(spark, d, "part").select("p_partkey", tx.unaccented(F.expr(NAME)).alias("name"))


@query(
    "text_names",
    rf"""WITH {NAMED} SELECT p_partkey, plain, regexp_replace(regexp_replace(plain, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM n""",
)
def text_names(spark, d):
    """Names with accents and marks put in, folded."""
    return named(spark, d).select("p_partkey", tx.plain_name(F.col("name"), folded=True).alias("plain"), tx.slug(F.col("name"), folded=True).alias("slug"))


@query(
    "text_surname_key",
    rf"""WITH {NAMED}, w AS (SELECT p_partkey, list_filter(string_split(plain, ' '), lambda x: x <> '') AS w FROM n),
k AS (SELECT *, list_filter(w, lambda x: length(x) = 1) AS i, list_filter(w, lambda x: length(x) > 1) AS l FROM w)
SELECT p_partkey, CASE WHEN len(l) = 0 THEN coalesce(w[1], '') WHEN len(l) = 1 AND len(i) = 0 THEN l[1] ELSE l[-1] || '|' || coalesce(i[1], left(l[1], 1)) END AS key FROM k""",
)
def text_surname_key(spark, d):
    return named(spark, d).select("p_partkey", tx.surname_key(F.col("name"), folded=True).alias("key"))


@query(
    "text_vocabulary",
    """SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'slam' WHEN '2' THEN 'masters' WHEN '3' THEN 'main' ELSE 'other' END AS level, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS code,
  TRY_CAST(o_orderpriority AS DOUBLE) AS whole FROM orders""",
)
def text_vocabulary(spark, d):
    code = F.substring("o_orderpriority", 1, 1)
    return table(spark, d, "orders").select(
        "o_orderkey", tx.mapped(code, {"1": "slam", "2": "masters", "3": "main"}, "other").alias("level"), tx.number(code).alias("code"), tx.number(F.col("o_orderpriority")).alias("whole")
    )


@query(
    "text_dates",
    """WITH x AS (SELECT o_orderkey, year(o_orderdate) * 10000 + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE month(o_orderdate) END * 100 + CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE day(o_orderdate) END AS n FROM orders)
SELECT o_orderkey, CAST(TRY_STRPTIME(CAST(n AS VARCHAR), '%Y%m%d')::DATE AS VARCHAR) AS day, n // 10000 AS season,
  date_diff('day', DATE '0001-01-01', make_date(n // 10000, greatest(1, n // 100 % 100), greatest(1, n % 100))) + 1 AS ordinal FROM x""",
)
def text_dates(spark, d):
    n = F.year("o_orderdate") * 10000 + F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(F.month("o_orderdate")) * 100 + F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(F.dayofmonth("o_orderdate"))
    rows = table(spark, d, "orders").select("o_orderkey", n.cast("long").alias("n"))
    return rows.select("o_orderkey", tx.day_of(F.col("n")).cast("string").alias("day"), F.floor(F.col("n") / 10000).cast("long").alias("season"), tx.ordinal(F.col("n")).cast("long").alias("ordinal"))


SCORE = """concat(l_linenumber % 8, '-', l_suppkey % 8, ' ', l_partkey % 8, '-', CAST(l_quantity AS BIGINT) % 8, CASE WHEN l_orderkey % 5 = 0 THEN concat(' 7-6(', l_suppkey % 10, ')') WHEN l_orderkey % 7 = 0 THEN ' [10-8]' ELSE '' END,
  CASE WHEN l_orderkey % 11 = 0 THEN ' RET' WHEN l_orderkey % 13 = 0 THEN ' W/O' WHEN l_orderkey % 17 = 0 THEN ' DEF' WHEN l_orderkey % 19 = 0 THEN ' 44-2' WHEN l_orderkey % 23 = 0 THEN ' xx' WHEN l_orderkey % 29 = 0 THEN ' 6-3 4-6 6-1 7-5' ELSE '' END)"""


@query(
    "text_scores",
    rf"""WITH s AS (SELECT {SCORE} AS score, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT *, list_filter(regexp_split_to_array(translate(score, '[]', ''), '\s+'), lambda x: x NOT IN ('', 'RET', 'DEF', 'W/O', 'ABN', 'ABD', '(RET)', '-')) AS t FROM s),
f AS (SELECT *, list_filter(t, lambda x: regexp_full_match(x, '\d{{1,2}}-\d{{1,2}}(\(\d+\))?') AND TRY_CAST(regexp_extract(x, '^(\d+)-', 1) AS INT) <= 30 AND TRY_CAST(regexp_extract(x, '-(\d+)', 1) AS INT) <= 30) AS g FROM k),
z AS (SELECT *, CASE WHEN contains(score, 'W/O') THEN 'walkover' WHEN contains(score, 'DEF') THEN 'default' WHEN contains(score, 'RET') THEN 'retired' WHEN len(g) = 0 THEN 'unfinished' ELSE 'completed' END AS status FROM f),
y AS (SELECT *, CASE WHEN status = 'walkover' THEN [] ELSE list_transform(g, lambda x: [regexp_extract(x, '^(\d+)-', 1)::INT, regexp_extract(x, '-(\d+)', 1)::INT]) END AS p FROM z),
v AS (SELECT *, len(list_filter(p, lambda x: x[1] > x[2])) AS won, len(list_filter(p, lambda x: x[2] > x[1])) AS lost FROM y)
SELECT score, status, len(p) AS n_sets, n, CAST(coalesce(list_sum(list_transform(p, lambda x: x[1] + x[2])), 0) AS BIGINT) AS games, CAST(coalesce(list_sum(list_transform(p, lambda x: x[1] - x[2])), 0) AS BIGINT) AS margin,
  CASE WHEN status = 'walkover' THEN 0 ELSE len(list_filter(g, lambda x: contains(x, '('))) END AS tiebreaks,
  status = 'completed' AND len(t) = len(g) AND len(p) <= 5 AND won > lost AND won IN (2, 3) AND lost <= 2 AND p[-1][1] > p[-1][2] AS usable FROM v""",
)
def text_scores(spark, d):
    """Scores made from numbers at hand, parsed into sets, games, margin, status; equal scores are parsed once."""
    scores = table(spark, d, "lineitem").select(F.expr(SCORE).alias("score")).groupBy("score").agg(F.count("*").alias("n"))
    long = [F.col(c).cast("long").alias(c) for c in ("n_sets", "games", "margin", "tiebreaks")]
    return tx.with_score(scores, "score").select("score", "status", "n", *long, "usable")


@query(
    "text_side_choice",
    "SELECT match_id, CAST('0x' || left(md5(CAST(match_id AS VARCHAR)), 2) AS INT) % 2 = 0 AS winner_first FROM contest",
    "contest",
)
def text_side_choice(spark, d):
    return contest(spark, d).select("match_id", tx.lower_first(F.col("match_id")).alias("winner_first"))


@query(
    "text_orientation",
    """WITH s AS (SELECT match_id, margin, CAST('0x' || left(md5(CAST(match_id AS VARCHAR)), 2) AS INT) % 2 = 0 AS w1, winner_id, loser_id FROM contest)
SELECT match_id, CASE WHEN w1 THEN winner_id ELSE loser_id END AS p1_id, CASE WHEN w1 THEN loser_id ELSE winner_id END AS p2_id, CASE WHEN w1 THEN 1 ELSE 0 END AS y_win, CASE WHEN w1 THEN margin ELSE -margin END AS y_spread FROM s""",
    "contest",
)
def text_orientation(spark, d):
    """Winner and loser as first and second side, the choice being independent of the outcome; labels follow."""
    first = tx.lower_first(F.col("match_id"))
    return contest(spark, d).select(
        "match_id", F.when(first, F.col("winner_id")).otherwise(F.col("loser_id")).alias("p1_id"), F.when(first, F.col("loser_id")).otherwise(F.col("winner_id")).alias("p2_id"),
        F.when(first, 1).otherwise(0).alias("y_win"), F.when(first, F.col("margin")).otherwise(-F.col("margin")).alias("y_spread"),
    )


@query(
    "value_transforms",
    "SELECT match_id, round(ln(p_win / (1 - p_win)), 6) AS logit, round(1 / (1 + exp(-p_win)), 6) AS sigmoid, CASE WHEN y_win > 0 THEN round(p_win / y_win, 9) END AS safe, round(ln(1 + p_win), 6) AS log1p FROM forecast",
    "forecast",
)
def value_transforms(spark, d):
    p = F.col("p_win")
    return forecast(spark, d).select("match_id", F.round(mk.logit(p), 6).alias("logit"), F.round(mk.sigmoid(p), 6).alias("sigmoid"), F.when(F.col("y_win") > 0, F.round(p / F.col("y_win"), 9)).alias("safe"), F.round(F.log1p(p), 6).alias("log1p"))


SP = "(0.5e0 + p_win * 3e-1)"


@query(
    "scoring_game",
    f"SELECT match_id, round(pow({SP}, 4) * (1 + 4 * (1 - {SP}) + 10 * (1 - {SP}) ** 2) + 20 * pow({SP} * (1 - {SP}), 3) * {SP} ** 2 / ({SP} ** 2 + (1 - {SP}) ** 2), 6) AS hold, round(greatest(0.3, least(0.9, {SP} - 0.36 + 1 - 0.6386)), 6) AS matchup FROM forecast",
    "forecast",
)
def scoring_game(spark, d):
    p = 0.5 + F.col("p_win") * 0.3
    return forecast(spark, d).select("match_id", F.round(prob.game(p), 6).alias("hold"), F.round(prob.matchup(p, F.lit(0.36)), 6).alias("matchup"))


@query(
    "scoring_match",
    "SELECT match_id, round(p_win ** 2 * (3 - 2 * p_win), 6) AS best_of_3, round(pow(p_win, 3) * (10 - 15 * p_win + 6 * p_win ** 2), 6) AS best_of_5, round(p_win * 0.4 / (p_win * 0.4 + (1 - p_win) * 0.6), 6) AS race FROM forecast",
    "forecast",
)
def scoring_match(spark, d):
    p = F.col("p_win")
    return forecast(spark, d).select("match_id", F.round(prob.match(p, F.lit(3)), 6).alias("best_of_3"), F.round(prob.match(p, F.lit(5)), 6).alias("best_of_5"), F.round(prob.race(p, F.lit(0.6)), 6).alias("race"))


CHAIN_SQL = """WITH RECURSIVE c AS (SELECT DISTINCT round(0.55e0 + p_win * 2e-1, 3) AS a, 64e-2 AS b FROM forecast),
t(a, b, i, j, p) AS (SELECT a, b, 0, 0, 1e0 FROM c UNION ALL SELECT a, b, i + x, j + 1 - x, sum(p * CASE WHEN x = 1 THEN own ELSE 1 - own END) FROM
  (SELECT *, CASE WHEN (i + j + 1) // 2 % 2 = 0 THEN a ELSE 1 - b END AS own FROM t WHERE i < 7 AND j < 7 AND NOT (i = 6 AND j = 6)), (VALUES (0), (1)) v(x) GROUP BY a, b, i + x, j + 1 - x),
tb AS (SELECT a, b, sum(CASE WHEN i = 7 AND j < 6 THEN p WHEN i = 6 AND j = 6 THEN p * a * (1 - b) / (a * (1 - b) + (1 - a) * b) ELSE 0 END) AS tiebreak FROM t GROUP BY a, b),
h AS (SELECT a, b, pow(a, 4) * (1 + 4 * (1 - a) + 10 * (1 - a) ** 2) + 20 * pow(a * (1 - a), 3) * a ** 2 / (a ** 2 + (1 - a) ** 2) AS ha, pow(b, 4) * (1 + 4 * (1 - b) + 10 * (1 - b) ** 2) + 20 * pow(b * (1 - b), 3) * b ** 2 / (b ** 2 + (1 - b) ** 2) AS hb FROM c),
g(a, b, ha, hb, i, j, p) AS (SELECT a, b, ha, hb, 0, 0, 1e0 FROM h UNION ALL SELECT a, b, ha, hb, i + x, j + 1 - x, sum(p * CASE WHEN x = 1 THEN own ELSE 1 - own END) FROM
  (SELECT *, CASE WHEN (i + j) % 2 = 0 THEN ha ELSE 1 - hb END AS own FROM g WHERE i < 7 AND j < 7 AND NOT (i = 6 AND j = 6) AND NOT (greatest(i, j) = 6 AND abs(i - j) >= 2)), (VALUES (0), (1)) v(x) GROUP BY a, b, ha, hb, i + x, j + 1 - x),
s AS (SELECT g.a, g.b, any_value(tiebreak) AS tiebreak, sum(CASE WHEN i = 6 AND j < 5 OR i = 7 THEN p WHEN i = 6 AND j = 6 THEN p * tiebreak ELSE 0 END) AS st FROM g JOIN tb ON tb.a = g.a AND tb.b = g.b GROUP BY g.a, g.b)
SELECT match_id, s.a, round(tiebreak, 6) AS tiebreak, round(st, 6) AS "set", round(st ** 2 * (3 - 2 * st), 6) AS "match" FROM forecast JOIN s ON s.a = round(0.55e0 + p_win * 2e-1, 3)"""


@query("scoring_chain", CHAIN_SQL, "forecast")
def scoring_chain(spark, d):
    """Point, tiebreak, set and match for each distinct pair of serve chances, joined back to the matches."""
    rows = forecast(spark, d).select("match_id", F.round(0.55 + F.col("p_win") * 0.2, 3).alias("a"), F.lit(0.64).alias("b"))
    chances = rows.select("a", "b").distinct()
    chances = chances.withColumn("tiebreak", prob.tiebreak_chance("a", "b")).withColumn("set", prob.set_chance("a", "b")).withColumn("match", prob.match(F.col("set"), F.lit(3)))
    return rows.join(chances, ["a", "b"]).select("match_id", "a", *[F.round(c, 6).alias(c) for c in ("tiebreak", "set", "match")])


def pooled(spark, d, pool: str = "surface"):
    """The contests as results of pools; within a pool the surface is whether the match was cut short."""
    rows = contest(spark, d)
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return rows.select(
        F.col(pool).alias("pool"), "match_id", day.alias("day"), F.floor(day / 7).alias("season"), F.when(F.col("retired"), "short").otherwise("full").alias("surface"),
        "winner_id", "loser_id", "margin", F.lit(False).alias("walkover"),
    )


ELO_SQL = """WITH RECURSIVE m AS (SELECT row_number() OVER (PARTITION BY surface ORDER BY match_id) i, match_id, surface AS pool, surface || '|' || winner_id w, surface || '|' || loser_id l FROM contest),
e(kind, id, r, r2, n, i) USING KEY (kind, id) AS (
 SELECT 'p', p, 1500.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT FROM (SELECT w p FROM m UNION SELECT l FROM m)
 UNION (WITH cur AS (SELECT max(i) i FROM recurring.e),
  x AS (SELECT m.i, m.match_id, m.w, m.l, a.r ra, b.r rb, a.n na, b.n nb FROM m, cur, recurring.e a, recurring.e b WHERE m.i = cur.i + 1 AND a.kind = 'p' AND b.kind = 'p' AND a.id = m.w AND b.id = m.l)
  SELECT 'p', w, ra + 200 / pow(na + 5, 0.4) * (1 - 1 / (1 + pow(10, (rb - ra) / 400))), 0.0, na + 1, i FROM x
  UNION ALL SELECT 'p', l, rb - 200 / pow(nb + 5, 0.4) * (1 - 1 / (1 + pow(10, (rb - ra) / 400))), 0.0, nb + 1, i FROM x
  UNION ALL SELECT 'm', CAST(match_id AS VARCHAR), ra, rb, 0, i FROM x))
SELECT m.pool, m.match_id, round(r, 6) AS w_elo, round(r2, 6) AS l_elo FROM e JOIN m ON e.id = CAST(m.match_id AS VARCHAR) WHERE kind = 'm'"""


@query("rating_elo", ELO_SQL, "contest")
def rating_elo(spark, d):
    return ratings.elo(pooled(spark, d), ["pool"]).select("pool", "match_id", F.round("w_elo", 6).alias("w_elo"), F.round("l_elo", 6).alias("l_elo"))


@query("rating_elo_resumed", ELO_SQL + " AND m.match_id > (SELECT median(match_id) FROM contest)", "contest")
def rating_elo_resumed(spark, d):
    """Ratings of the later half of all results, folded from the state that the earlier half left."""
    rows = pooled(spark, d)
    half = quantiles(rows, "match_id", {"half": 0.5}).first()[0]
    state = ratings.elo_state(rows.filter(F.col("match_id") <= half), ["pool"])
    later = ratings.elo(rows.filter(F.col("match_id") > half), ["pool"], state=state)
    return later.select("pool", "match_id", F.round("w_elo", 6).alias("w_elo"), F.round("l_elo", 6).alias("l_elo"))


CHANCE = "1 / (1 + pow(10, ({b} - {a}) / 400))"
SURFACE_SQL = f"""WITH RECURSIVE m AS (SELECT row_number() OVER (PARTITION BY surface ORDER BY match_id) i, match_id, surface AS pool, surface || '|' || winner_id w, surface || '|' || loser_id l, retired AS cut FROM contest),
e(kind, id, r, s, f, x, n, ns, nf, i) USING KEY (kind, id) AS (
 SELECT 'p', p, 1500e0, 0e0, 0e0, 0e0, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT w p FROM m UNION SELECT l FROM m)
 UNION (WITH cur AS (SELECT max(i) i FROM recurring.e),
  t AS (SELECT m.*, a.r ra, b.r rb, a.n na, b.n nb, a.s sa, a.f fa, b.s sb, b.f fb, a.ns sna, a.nf fna, b.ns snb, b.nf fnb, CASE WHEN cut THEN a.ns ELSE a.nf END ka, CASE WHEN cut THEN b.ns ELSE b.nf END kb,
    CASE WHEN cut THEN a.s ELSE a.f END oa, CASE WHEN cut THEN b.s ELSE b.f END ob FROM m, cur, recurring.e a, recurring.e b WHERE m.i = cur.i + 1 AND a.kind = 'p' AND b.kind = 'p' AND a.id = m.w AND b.id = m.l),
  u AS (SELECT *, ra + 200 / pow(na + 5, 0.4) * (1 - {CHANCE.format(a="ra", b="rb")}) ua, rb - 200 / pow(nb + 5, 0.4) * (1 - {CHANCE.format(a="ra", b="rb")}) ub FROM t),
  v AS (SELECT *, CASE WHEN ka = 0 THEN ua ELSE oa END va, CASE WHEN kb = 0 THEN ub ELSE ob END vb FROM u),
  z AS (SELECT *, va + 200 / pow(ka + 5, 0.4) * (1 - {CHANCE.format(a="va", b="vb")}) wa, vb - 200 / pow(kb + 5, 0.4) * (1 - {CHANCE.format(a="va", b="vb")}) wb FROM v)
  SELECT 'p', w, ua, CASE WHEN cut THEN wa ELSE sa END, CASE WHEN cut THEN fa ELSE wa END, 0e0, na + 1, sna + CASE WHEN cut THEN 1 ELSE 0 END, fna + CASE WHEN cut THEN 0 ELSE 1 END, i FROM z
  UNION ALL SELECT 'p', l, ub, CASE WHEN cut THEN wb ELSE sb END, CASE WHEN cut THEN fb ELSE wb END, 0e0, nb + 1, snb + CASE WHEN cut THEN 1 ELSE 0 END, fnb + CASE WHEN cut THEN 0 ELSE 1 END, i FROM z
  UNION ALL SELECT 'm', CAST(match_id AS VARCHAR), ra, rb, (ka * oa + 60 * ra) / (ka + 60), (kb * ob + 60 * rb) / (kb + 60), 0, 0, 0, i FROM z))
SELECT m.pool, m.match_id, round(r, 6) AS w_elo, round(s, 6) AS l_elo, round(f, 6) AS w_surface_elo, round(x, 6) AS l_surface_elo FROM e JOIN m ON e.id = CAST(m.match_id AS VARCHAR) WHERE kind = 'm'"""


@query("rating_elo_surface", SURFACE_SQL, "contest")
def rating_elo_surface(spark, d):
    """Overall ratings and those of each surface, blended by matches played on it."""
    rated = ratings.elo(pooled(spark, d), ["pool"])
    return rated.select("pool", "match_id", *[F.round(c, 6).alias(c) for c in ("w_elo", "l_elo", "w_surface_elo", "l_surface_elo")])


SWEEP_SQL = """WITH RECURSIVE rules(rule, scale, power, weighted, keep) AS (VALUES ('usual', 200e0, 4e-1, false, 1e0), ('constant k', 32e0, 0e0, false, 1e0), ('no drift', 200e0, 4e-1, false, 1e0), ('by margin', 200e0, 4e-1, true, 1e0), ('by season', 200e0, 4e-1, false, 7e-1)),
m AS (SELECT rule, scale, power, keep, dense_rank() OVER (PARTITION BY rule, surface ORDER BY date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7) AS epoch, CASE WHEN weighted THEN least(1.8e0, greatest(0.5e0, ln(1 + greatest(0, margin)) / ln(6))) ELSE 1e0 END AS f, row_number() OVER (PARTITION BY rule, surface ORDER BY match_id) i, rule || '|' || match_id AS id,
  rule || '|' || surface || '|' || winner_id w, rule || '|' || surface || '|' || loser_id l FROM contest, rules),
e(kind, id, r, r2, n, epoch, i) USING KEY (kind, id) AS (
 SELECT 'p', p, 1500e0, 0e0, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT w p FROM m UNION SELECT l FROM m)
 UNION (WITH cur AS (SELECT max(i) i FROM recurring.e),
  y AS (SELECT m.*, 1500 + (a.r - 1500) * pow(keep, m.epoch - a.epoch) ra, 1500 + (b.r - 1500) * pow(keep, m.epoch - b.epoch) rb, a.n na, b.n nb FROM m, cur, recurring.e a, recurring.e b WHERE m.i = cur.i + 1 AND a.kind = 'p' AND b.kind = 'p' AND a.id = m.w AND b.id = m.l),
  x AS (SELECT *, f * scale * (1 - 1 / (1 + pow(10, (rb - ra) / 400))) AS step FROM y)
  SELECT 'p', w, ra + step / pow(na + 5, power), 0e0, na + 1, epoch, i FROM x UNION ALL SELECT 'p', l, rb - step / pow(nb + 5, power), 0e0, nb + 1, epoch, i FROM x UNION ALL SELECT 'm', id, ra, rb, 0, 0, i FROM x)),
s AS (SELECT string_split(id, '|')[1] AS rule, 1 / (1 + pow(10, (r2 - r) / 400)) AS p FROM e WHERE kind = 'm')
SELECT rule, count(*) AS n, round(-avg(ln(p)), 6) AS log_loss, round(avg(CASE WHEN round(p, 9) > 0.5 THEN 1e0 ELSE 0 END), 6) AS accuracy FROM s GROUP BY rule"""


@query("rating_elo_sweep", SWEEP_SQL, "contest")
def rating_elo_sweep(spark, d):
    """Log loss of several rating rules: pools times rules in parallel, scored in one aggregation."""
    rules = {"usual": ratings.EloRule(), "constant k": ratings.EloRule(k_scale=32.0, k_power=0.0), "no drift": ratings.EloRule(idle_rate=0.0), "by margin": ratings.EloRule(margin_weight=True), "by season": ratings.EloRule(season_regress=0.3)}
    rated = ratings.elo_sweep(pooled(spark, d), ["pool"], rules)
    p = ratings.expected(F.col("w_elo"), F.col("l_elo"))
    return rated.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg(-F.ln(mk.clipped(p))), 6).alias("log_loss"), F.round(F.avg(F.when(F.round(p, 9) > 0.5, 1.0).otherwise(0.0)), 6).alias("accuracy"))


#: Matches of an event and the places at which its rounds begin: events of 16 players in the pool's order.
EVENT_MATCHES, ROUND_STARTS = 15, (0, 8, 12, 14)
REPLAY_SQL = ELO_SQL.replace("SELECT m.pool, m.match_id, round(r, 6) AS w_elo, round(r2, 6) AS l_elo FROM e JOIN m ON e.id = CAST(m.match_id AS VARCHAR) WHERE kind = 'm'", "SELECT * FROM replayed").replace(
    " FROM x))\n",
    f""" FROM x)),
rated AS (SELECT m.pool, m.i, (m.i - 1) // {EVENT_MATCHES} AS event, (m.i - 1) % {EVENT_MATCHES} AS place, m.w, m.l, r AS ra, r2 AS rb FROM e JOIN m ON e.id = CAST(m.match_id AS VARCHAR) WHERE kind = 'm'),
sides AS (SELECT pool, i, event, place, w AS id, ra AS own, 1 - 1 / (1 + pow(10, (rb - ra) / 400)) AS move FROM rated UNION ALL SELECT pool, i, event, place, l, rb, -(1 - 1 / (1 + pow(10, (rb - ra) / 400))) FROM rated),
after AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n, own + 200 / pow(row_number() OVER (PARTITION BY id ORDER BY i) + 4, 0.4) * move AS r FROM sides),
rounds(round, begins) AS (VALUES {", ".join(f"({r + 1}, {b})" for r, b in enumerate(ROUND_STARTS))}),
asked AS (SELECT s.pool, s.event, rounds.round, s.id, min(s.event * {EVENT_MATCHES} + begins + 1) AS cut FROM sides s JOIN rounds ON s.place >= begins GROUP BY ALL),
replayed AS (SELECT asked.pool, event, CAST(round AS BIGINT) AS round, CAST(string_split(asked.id, '|')[2] AS BIGINT) AS player_id, round(coalesce(h.r, 1500), 6) AS elo, coalesce(h.n, 0) AS played
  FROM asked ASOF LEFT JOIN (SELECT id, i, r, n FROM after) h ON asked.id = h.id AND asked.cut > h.i)
""",
)


@query("rating_replay", REPLAY_SQL, "contest")
def rating_replay(spark, d):
    """Events of each pool replayed from every round: what each player who still plays in it was rated when that round began. One fold for all events and rounds."""
    from ..operators.ordering import numbered

    placed = numbered(pooled(spark, d), "match_id", name="i", by=["pool"]).withColumn("event", F.floor((F.col("i") - 1) / EVENT_MATCHES)).withColumn("place", (F.col("i") - 1) % EVENT_MATCHES)
    placed = written(placed, "placed")
    rounds = F.explode(F.filter(F.array(*[F.struct(F.lit(r + 1).alias("round"), F.lit(b).alias("begins")) for r, b in enumerate(ROUND_STARTS)]), lambda x: x["begins"] <= F.col("place"))).alias("x")
    sides = placed.select("pool", "event", rounds, F.explode(F.array("winner_id", "loser_id")).alias("player_id")).select("pool", "event", "x.round", "player_id", (F.col("event") * EVENT_MATCHES + F.col("x.begins") + 1).alias("i"))
    opens = placed.select("pool", "i", "match_id", "day", "surface")
    asked = sides.distinct().join(opens, ["pool", "i"]).withColumn("ask_id", F.col("event") * len(ROUND_STARTS) + F.col("round"))
    answers = ratings.elo_asked(placed, asked, ["pool"])
    n = len(ROUND_STARTS)
    return answers.select("pool", F.floor((F.col("ask_id") - 1) / n).alias("event"), ((F.col("ask_id") - 1) % n + 1).alias("round"), "player_id", F.round("elo", 6).alias("elo"), "played")


def seen_sql(p: str) -> str:
    """Serve and return of player p (a or b) as seen before a match: shrunk by their points, blended with the surface's."""
    own = lambda c: f"CASE WHEN slow THEN {p}.{c}1 ELSE {p}.{c}2 END"
    n = f"({own('n')})"
    blend = lambda c, k: f"(1 - 0.35e0 * {n} / ({n} + 400)) * {p}.{c} * {p}.{k} / ({p}.{k} + 400) + 0.35e0 * {n} / ({n} + 400) * ({own(c)}) * {n} / ({n} + 400)"
    return f"{blend('s', 'ns')} AS {p}_s, {blend('b', 'nb')} AS {p}_b"


def served_sql(side: str, other: str, up: str, down: str, points: str, returned: str) -> str:
    """The state of a side after a match: its own serve moves up, its return moves against the other's."""
    own = lambda i, cond: f"p.{side}s{i} + CASE WHEN {cond} THEN {up} ELSE 0 END, p.{side}b{i} - CASE WHEN {cond} THEN {down} ELSE 0 END, p.{side}n{i} + CASE WHEN {cond} THEN wp + lp ELSE 0 END"
    return f"SELECT 'p', {other}, p.{side}s + {up}, p.{side}b - {down}, p.{side}ns + {points}, p.{side}nb + {returned}, {own(1, 'slow')}, {own(2, 'NOT slow')}, i FROM y p WHERE wp > 0 AND lp > 0"


STATE_COLUMNS = "s b ns nb s1 b1 n1 s2 b2 n2".split()
SERVE_SQL = f"""WITH RECURSIVE m AS (SELECT row_number() OVER (PARTITION BY surface ORDER BY match_id) i, match_id, surface AS pool, surface || '|' || winner_id w, surface || '|' || loser_id l, match_id % 3 = 0 AS slow,
  floor(total)::DOUBLE wp, floor(total * 0.65e0)::DOUBLE ww, CASE WHEN NOT retired THEN floor(total)::DOUBLE END lp, floor(total * 0.6e0)::DOUBLE lw FROM contest),
e(kind, id, {", ".join(STATE_COLUMNS)}, i) USING KEY (kind, id) AS (
 SELECT 'p', p, {", ".join("0e0" for _ in STATE_COLUMNS)}, 0::BIGINT FROM (SELECT w p FROM m UNION SELECT l FROM m)
 UNION (WITH cur AS (SELECT max(i) i FROM recurring.e),
  x AS (SELECT m.*, {seen_sql("a")}, {seen_sql("b")}, {", ".join(f"{p}.{c} AS {p}{c}" for p in "ab" for c in STATE_COLUMNS)} FROM m, cur, recurring.e a, recurring.e b WHERE m.i = cur.i + 1 AND a.kind = 'p' AND b.kind = 'p' AND a.id = m.w AND b.id = m.l),
  y AS (SELECT *, 0.04e0 * (ww / nullif(wp, 0) - (0.62e0 + a_s - b_b)) * least(wp / 100, 1.5e0) AS up1, 0.04e0 * (lw / nullif(lp, 0) - (0.62e0 + b_s - a_b)) * least(lp / 100, 1.5e0) AS up2 FROM x)
  {served_sql("a", "w", "up1", "up2", "wp", "lp")} UNION ALL {served_sql("b", "l", "up2", "up1", "lp", "wp")}
  UNION ALL SELECT 'm', CAST(match_id AS VARCHAR), a_s, a_b, b_s, b_b, 0, 0, 0, 0, 0, 0, i FROM y))
SELECT m.pool, m.match_id, round(s, 9) + 0 AS w_serve, round(b, 9) + 0 AS w_return, round(ns, 9) + 0 AS l_serve, round(nb, 9) + 0 AS l_return FROM e JOIN m ON e.id = CAST(m.match_id AS VARCHAR) WHERE kind = 'm'"""


@query("rating_serve_return", SERVE_SQL, "contest")
def rating_serve_return(spark, d):
    rows = contest(spark, d).select(
        F.col("surface").alias("pool"), "match_id", F.when(F.col("match_id") % 3 == 0, "slow").otherwise("fast").alias("surface"), "winner_id", "loser_id", F.floor("total").cast("double").alias("w_points"), F.floor(F.col("total") * 0.65).cast("double").alias("w_won"),
        F.when(~F.col("retired"), F.floor("total").cast("double")).alias("l_points"), F.floor(F.col("total") * 0.6).cast("double").alias("l_won"),
    )
    rated = ratings.serve_return(rows, ["pool"], 0.62)
    return rated.select("pool", "match_id", *[(F.round(c, 9) + 0.0).alias(c) for c in ("w_serve", "w_return", "l_serve", "l_return")])


@query(
    "rating_expected",
    "SELECT match_id, round(1 / (1 + pow(10, (p_win * 400 - 200) / 400)), 6) AS p, round(200 / pow(player_id % 50 + 5, 0.4), 6) AS k FROM forecast",
    "forecast",
)
def rating_expected(spark, d):
    n = F.col("player_id") % 50
    return forecast(spark, d).select("match_id", F.round(ratings.expected(F.lit(0.0), F.col("p_win") * 400 - 200), 6).alias("p"), F.round(ratings.k_factor(n), 6).alias("k"))


@query(
    "rating_relative",
    """WITH r AS (SELECT player_id, surface, avg(won) AS rate, count(*) AS n FROM player_match GROUP BY ALL), m AS (SELECT surface, median(rate) AS mid FROM r WHERE n >= 5 GROUP BY surface)
SELECT player_id, surface, CASE WHEN n >= 5 THEN round(rate - mid, 6) END AS relative FROM r JOIN m USING (surface)""",
    "contest player_match",
)
def rating_relative(spark, d):
    """Each player against the median of the qualified field on a surface; thin samples have no value."""
    from .views import player_match

    rates = player_match(contest(spark, d)).groupBy("player_id", "surface").agg(F.avg("won").alias("rate"), F.count("*").alias("n"))
    field = quantiles(rates.filter("n >= 5"), "rate", {"mid": 0.5}, ["surface"])
    return rates.join(field, "surface", "left").select("player_id", "surface", F.when(F.col("n") >= 5, F.round(F.col("rate") - F.col("mid"), 6)).alias("relative"))


@query("order_numbered", "SELECT match_id, row_number() OVER (ORDER BY play_ts, match_id) AS seq FROM forecast", "forecast")
def order_numbered(spark, d):
    """A number in play order over all rows, by ranges and their sizes."""
    from ..operators.ordering import numbered

    return numbered(forecast(spark, d).select("match_id", "play_ts"), "play_ts", "match_id").select("match_id", "seq")
