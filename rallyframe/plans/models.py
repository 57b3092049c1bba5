"""Queries that fit and compare models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..operators import metrics, models
from ..operators.ordering import numbered
from ..session import written
from .registry import query
from .views import forecast, priced, table


def inputs(spark, d):
    """Forecasts with a market chance and a noisy input with gaps, labelled by whether the order was a large one."""
    rows = priced(spark, d).withColumn("market", mk.shin(F.col("p1_price"), F.col("p2_price")))
    gap = F.when(F.col("match_id") % 7 != 0, F.col("overround"))
    rows = rows.select("match_id", "season", "play_ts", F.when(F.col("p_win") + F.pmod(F.xxhash64("match_id"), F.lit(100)) / 250 > 0.7, 1.0).otherwise(0.0).alias("label"), "p_win", "market", gap.alias("over"), "surface", "player_id")
    return written(rows, "inputs")  # means, fits and scores each read them: without this every one would join and shuffle the prices anew


@query("model_walk_forward")
def model_walk_forward(spark, d):
    rows, features = models.with_indicators(inputs(spark, d), ["p_win", "market", "over"])
    out = models.walk_forward(rows, features, "label", ["play_ts", "match_id"])
    return out.groupBy("season").agg(*metrics.classification(F.col("label"), F.col("p")))


def named_settings(summary, settings: list[dict]):
    """A sweep's summary with its settings by name."""
    fields = sorted({k for one in settings for k in one})
    names = F.array(*[F.struct(*[F.lit(one.get(k)).cast("double").alias(k) for k in fields]) for one in settings])
    rounded = summary.select(F.get(names, F.col("setting")).alias("s"), "seasons", *[F.round(c, 6).alias(c) for c in ("log_loss", "accuracy", "trained_on")], "wins")
    return rounded.select("s.*", "seasons", "log_loss", "accuracy", "trained_on", "wins")


@query("model_history_sweep")
def model_history_sweep(spark, d):
    """How much history helps: one, two, three or all seasons before the one that is scored."""
    rows, features = models.with_indicators(inputs(spark, d), ["p_win", "market", "over"])
    settings = [{"window": w} for w in (1, 2, 3, None)]
    return named_settings(models.sweep_summary(models.swept(rows, features, "label", settings)), settings)


@query("model_random_search")
def model_random_search(spark, d):
    """Settings drawn at random, each scored on seasons in order and never on one it has seen."""
    rows, features = models.with_indicators(inputs(spark, d), ["p_win", "market", "over"])
    settings = models.random_settings({"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0], "window": [2, 4, None]}, 5, seed=3)
    return named_settings(models.sweep_summary(models.swept(rows, features, "label", settings, least=3)), settings)


@query("model_boosted")
def model_boosted(spark, d):
    """A boosted model fitted on all seasons but the last, scored on the last, with the importance of each input."""
    rows, features = models.with_indicators(inputs(spark, d), ["p_win", "market", "over"])
    last = rows.agg(F.max("season")).first()[0]
    model = models.fitted(rows.filter(F.col("season") < last), features, "label", "gbt")
    scores = models.scored(model, rows.filter(F.col("season") == last)).groupBy("season").agg(*metrics.classification(F.col("label"), F.col("p")))
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return scores.select("*", *[F.lit(w).alias(f"importance_{f}") for f, w in zip(features, weights, strict=True)])


@query("model_logistic_errors")
def model_logistic_errors(spark, d):
    """Coefficients with standard errors of a logistic fit on both logits, and the likelihood ratio against the market alone."""
    rows = inputs(spark, d).select("label", mk.logit(F.col("p_win")).alias("model"), mk.logit(F.col("market")).alias("book"))
    both, one = models.fitted(rows, ["model", "book"], "label", "binomial").stages[-1], models.fitted(rows, ["book"], "label", "binomial").stages[-1]
    ratio = one.summary.deviance - both.summary.deviance
    names = ["model", "book", "intercept"]
    values = zip(names, [*both.coefficients.toArray().tolist(), both.intercept], both.summary.coefficientStandardErrors, strict=True)
    parts = F.array(*[F.struct(F.lit(n).alias("term"), F.lit(float(c)).alias("coefficient"), F.lit(float(e)).alias("error"), F.lit(float(c / e)).alias("z")) for n, c, e in values])
    return rows.agg(F.count("*").alias("n")).select("n", F.lit(float(ratio)).alias("likelihood_ratio"), F.explode(parts).alias("t")).select("n", "likelihood_ratio", "t.*")


@query("model_feature_redundancy")
def model_feature_redundancy(spark, d):
    """How much of an input the others explain."""
    rows, features = models.with_indicators(inputs(spark, d), ["p_win", "market", "over"])
    fit = models.fitted(rows, ["market", *[f for f in features if f.startswith("over")]], "p_win", "linear")
    return rows.agg(F.count("*").alias("n")).select("n", F.lit(float(fit.stages[-1].summary.r2)).alias("r2"))


@query("model_permutation")
def model_permutation(spark, d):
    """Loss of log likelihood when an input is replaced by that of another row of its season (a hash decides which)."""
    rows, features = models.with_indicators(inputs(spark, d), ["p_win", "market", "over"])
    model = models.fitted(rows, features, "label")
    keyed = numbered(rows, "match_id", name="_i", by=["season"])
    moved = numbered(rows.select("season", "match_id", "p_win", "market", "over"), F.xxhash64("match_id"), "match_id", name="_i", by=["season"])
    names = ("p_win", "market", "over")
    mixed = keyed.join(moved.select("season", "_i", *[F.col(f).alias(f"_v_{f}") for f in names]), ["season", "_i"])
    found = models.scored(model, mixed, "_p_none")  # one join and one pass for all inputs
    for f in names:
        swapped = found.withColumns({"_own": F.col(f), f: F.col(f"_v_{f}")})
        found = models.scored(model, swapped, f"_p_{f}").withColumn(f, F.col("_own")).drop("_own")
    losses = found.agg(*[mk.log_loss(F.col("label"), F.col(f"_p_{f}")).alias(f) for f in (*names, "none")])
    return losses.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("loss")) for f in (*names, "none")])).alias("x")).select("x.*")


@query(
    "model_symmetrised",
    "SELECT match_id, round((p_win + 1 - (1 - p_win * 0.9)) / 2, 9) AS chance, round((p_win * 20 + p_win * 22) / 2, 9) AS total, round((p_win * 4 - p_win * -2) / 2, 9) AS spread FROM forecast",
    "forecast",
)
def model_symmetrised(spark, d):
    p = F.col("p_win")
    s = models.symmetrised
    return forecast(spark, d).select("match_id", F.round(s(p, 1 - p * 0.9), 9).alias("chance"), F.round(s(p * 20, p * 22, "total"), 9).alias("total"), F.round(s(p * 4, p * -2, "spread"), 9).alias("spread"))


RESIDUAL = """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 3 AS g, l_quantity AS pred, l_extendedprice / 1000 AS actual, 30e0 AS line FROM lineitem),
q AS (SELECT g, quantile_cont(pred, [1/6, 2/6, 3/6, 4/6, 5/6]) AS edges FROM r GROUP BY g),
c AS (SELECT r.*, len(list_filter(edges, lambda e: e < pred)) AS cell FROM r JOIN q USING (g)),
n AS (SELECT *, count(*) OVER (PARTITION BY g, cell) AS nc, count(*) OVER (PARTITION BY g) AS ng FROM c),
a AS (SELECT *, CASE WHEN nc >= 500 THEN g || '/' || cell WHEN ng >= 500 THEN g || '' ELSE '*' END AS pool, line - pred AS v FROM n),
e AS (SELECT unnest([g || '/' || cell, g || '', '*']) AS pool, actual - pred AS v FROM c), s AS (SELECT pool, count(*) AS size FROM e GROUP BY pool),
k AS (SELECT pool, v, sum(count(*)) OVER (PARTITION BY pool ORDER BY v) AS below FROM e GROUP BY pool, v),
f AS (SELECT a.g, a.line, least(1 - 1e-6, greatest(1e-6, 1 - coalesce(k.below, 0) / s.size)) AS p FROM a ASOF LEFT JOIN k ON a.pool = k.pool AND a.v >= k.v JOIN s ON s.pool = a.pool)
SELECT g, count(*) AS n, round(avg(p), 6) AS p_over FROM f GROUP BY g"""


@query("model_residual_chance", RESIDUAL)
def model_residual_chance(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("g"), F.col("l_quantity").cast("double").alias("pred"), (F.col("l_extendedprice") / 1000).alias("actual"), F.lit(30.0).alias("line"))
    return models.residual_chance(rows, "g", "pred", "actual", "line").groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("p_over"), 6).alias("p_over"))


@query(
    "model_wilcoxon",
    """WITH d AS (SELECT p_win - 0.5 AS d FROM forecast WHERE p_win <> 0.5), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS k FROM d),
s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w FROM r) SELECT n, round(w, 4) AS w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s""",
    "forecast",
)
def model_wilcoxon(spark, d):
    return models.wilcoxon(forecast(spark, d).withColumn("half", F.lit(0.5)), "p_win", "half")


@query("model_selection_bias")
def model_selection_bias(spark, d):
    """The best of as many chance results as there are books: what selection alone would show."""
    from ..operators.betting import uniform
    from .views import price

    books = price(spark, d).select("book").distinct()
    draws = books.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(400))))
    u1, u2 = uniform(1, F.col("trial"), F.col("book")), uniform(2, F.col("trial"), F.col("book"))
    normal = F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * F.pi() * u2)
    best = draws.groupBy("trial").agg(F.max(normal).alias("best"))
    return best.agg(F.count("*").alias("trials"), F.round(F.avg("best"), 4).alias("mean_best"), F.round(F.percentile("best", 0.95), 4).alias("p95_best"))
