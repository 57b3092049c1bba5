"""Models by their values: planted optima, fits by hand, and folds that see the past only."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from rallyframe.operators import models
from rallyframe.operators.ordering import quantiles


def planted(n=400, seasons=range(2001, 2007)):
    """y follows x before 2004 and its opposite from then on."""
    rng = random.Random(9)
    return [(s, x := rng.gauss(0, 1), float(rng.random() < 1 / (1 + np.exp(-2 * x * (1 if s < 2004 else -1))))) for s in seasons for _ in range(n)]


def newton(x, y, steps=30):
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-12 * np.eye(2), x.T @ (y - p))
    return w


def test_history_sweep_finds_the_planted_window(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "season int, x double, y double")
    settings = [{"window": 1}, {"window": 3}, {"window": None}, {"window": None, "regParam": 100.0}]
    scores = models.swept(df, ["x"], "y", settings)
    got = {(r.season, r.setting): r for r in scores.collect()}
    assert sorted(got) == [(s, i) for s in range(2003, 2007) for i in range(4)]
    for (s, i), r in got.items():
        if i == 3:
            continue
        low = s - settings[i]["window"] if settings[i]["window"] else 2001
        old = np.array([(x, y) for t, x, y in rows if low <= t < s])
        new = np.array([(x, y) for t, x, y in rows if t == s])
        w = newton(old[:, 0], old[:, 1])
        p = 1 / (1 + np.exp(-(new[:, 0] * w[0] + w[1])))
        assert r.trained_on == len(old) and r.n == len(new)
        assert abs(r.log_loss + np.mean(np.where(new[:, 1] == 1, np.log(p), np.log(1 - p)))) < 1e-3
        assert abs(r.accuracy - np.mean((p >= 0.5) == (new[:, 1] == 1))) < 0.01
    summary = {r.setting: r for r in models.sweep_summary(scores).collect()}
    assert sum(r.wins for r in summary.values()) == 4 and {r.seasons for r in summary.values()} == {4}
    assert abs(summary[0].log_loss - np.mean([got[s, 0].log_loss for s in range(2003, 2007)])) < 1e-12
    # after the turn the short window sees it first
    assert got[2005, 0].log_loss < got[2005, 1].log_loss and got[2006, 0].log_loss < min(got[2006, i].log_loss for i in (1, 2))
    # before it all history is as good, and a season is never in its own fit: the turned one is lost by every window
    assert abs(got[2003, 0].log_loss - got[2003, 2].log_loss) < 0.02 and got[2004, 0].log_loss > 1 and got[2004, 2].log_loss > 1


def test_sweep_without_enough_history(spark):
    df = spark.createDataFrame(planted(20), "season int, x double, y double")
    settings = [{"window": 1}, {"window": None}]
    scores = models.swept(df, ["x"], "y", settings, least_rows=60)
    assert {(r.season, r.setting) for r in scores.collect()} == {(s, 1) for s in range(2004, 2007)}
    assert [r.setting for r in models.sweep_summary(scores).collect()] == [1]
    assert models.sweep_summary(models.swept(df.limit(0), ["x"], "y", settings)).collect() == []


def test_random_settings_differ_and_repeat():
    space = {"a": [1, 2, 3], "b": ["x", "y"], "window": [None, 4]}
    one = models.random_settings(space, 8, seed=5)
    assert one == models.random_settings(space, 8, seed=5) != models.random_settings(space, 8, seed=6)
    assert len({tuple(sorted(x.items(), key=str)) for x in one}) == 8 and all(x[k] in space[k] for x in one for k in space)
    assert len(models.random_settings(space, 100)) == 12


def test_quantiles_by_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, -3.5, rng.random()])) for _ in range(301)] + [("one", 4.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.0, "sixth": 1 / 6, "mid": 0.5, "high": 0.975, "top": 1.0}
    got = {r.g: list(r[1:]) for r in quantiles(df, "v", shares, ["g"]).collect()}
    groups = {g for g, v in rows if v is not None}
    assert set(got) == groups
    for g in groups:
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g and v is not None], list(shares.values())), atol=1e-12)
    whole = quantiles(df, "v", {"mid": 0.5}).collect()
    assert [list(r) for r in whole] == [[np.median([v for _, v in rows if v is not None])]]
    assert quantiles(df.limit(0), "v", shares, ["g"]).collect() == [] and quantiles(df.filter("v is null"), "v", shares).collect() == []


def test_wilcoxon_of_more_pairs_than_a_long_holds_cubed(spark):
    n = 2_200_000
    df = spark.range(n).select((F.col("id") % 50 - 20).cast("double").alias("a"), F.lit(0.0).alias("b"))
    got = models.wilcoxon(df, "a", "b").collect()[0]
    d = np.array([i - 20 for i in range(50) if i != 20])
    c = n // 50
    before = {m: c * int((abs(d) < m).sum()) for m in set(abs(d))}
    w = sum(c * (before[m] + (c * int((abs(d) == m).sum()) + 1) / 2) for m in d if m > 0)
    k = c * len(d)
    assert got.n == k and got.w == w
    assert abs(got.z - (w - k * (k + 1) / 4) / np.sqrt(float(k) * (k + 1) * (2 * k + 1) / 24)) < 1e-5


def test_inputs_are_worked_out_once_and_all_are_moved_in_one_pass(spark, sf_dir):
    from rallyframe.functions import market as mk
    from rallyframe.plans import models as plans

    assert "Exchange" not in plans.inputs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    got = plans.model_permutation(spark, sf_dir)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner, ((season") == 1
    losses = {r.feature: r.loss for r in got.collect()}
    assert sorted(losses) == ["market", "none", "over", "p_win"]
    # by hand: the same moves one at a time
    rows, features = models.with_indicators(plans.inputs(spark, sf_dir), ["p_win", "market", "over"])
    model = models.fitted(rows, features, "label")
    frame = rows.select("*", F.xxhash64("match_id").alias("h")).toPandas()
    keyed = frame.sort_values(["season", "match_id"]).reset_index(drop=True)
    moved = frame.sort_values(["season", "h", "match_id"]).reset_index(drop=True)
    for f in ("p_win", "market", "over", None):
        one = keyed.drop(columns="h")
        if f:
            one[f] = moved[f]
        want = models.scored(model, spark.createDataFrame(one)).agg(mk.log_loss(F.col("label"), F.col("p")).alias("x")).first().x
        assert abs(losses[f or "none"] - want) < 1e-6


def test_residual_chances_order_different_questions_only(spark, monkeypatch):
    rows = spark.range(3000).select(F.lit("a").alias("g"), (F.col("id") % 20).cast("double").alias("pred"), (F.col("id") % 37).cast("double").alias("actual"), F.lit(15.0).alias("line"))
    ordered = []
    real = models.running_totals
    monkeypatch.setattr(models, "running_totals", lambda rows, *a, **k: ordered.append(rows.count()) or real(rows, *a, **k))
    got = models.residual_chance(rows, "g", "pred", "actual", "line", cells=2, least=2000).collect()
    residuals = [(i % 37) - (i % 20) for i in range(3000)]
    assert len(got) == 3000 and ordered == [len(set(residuals)) + 20]
    for r in got[:50]:
        assert abs(r.p_over - min(1 - 1e-6, max(1e-6, 1 - sum(v <= 15 - r.pred for v in residuals) / 3000))) < 1e-9
