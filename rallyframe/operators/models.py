"""Models in walk-forward order with pyspark.ml, calibration, and the tests that compare them.

Folds are seasons: a model of a season sees only earlier ones. Missing inputs become a mean and an indicator column
before trees or linear models. All scoring is by DataFrame aggregation.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .ordering import numbered, quantiles, running_totals

#: Seasons that a fold needs before it, the part of a training window that fits (the rest calibrates), calibration's bounds.
LEAST_SEASONS = 2
FIT_SHARE = 0.85
LOW, HIGH = 0.01, 0.99


def with_indicators(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with nulls and NaNs of features filled by their mean, and a 0/1 column for each feature that had some."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    stats = rows.agg(*[F.avg(F.when(~bad(c), F.col(c))).alias(f"m_{c}") for c in features], *[F.count_if(bad(c)).alias(f"n_{c}") for c in features]).first()
    flagged = [c for c in features if stats[f"n_{c}"]]
    filled = [F.when(bad(c), F.lit(float(stats[f"m_{c}"] or 0.0))).otherwise(F.col(c).cast("double")).alias(c) for c in features]
    rest = [c for c in rows.columns if c not in features]
    return rows.select(*rest, *filled, *[bad(c).cast("double").alias(f"{c}_missing") for c in flagged]), [*features, *[f"{c}_missing" for c in flagged]]


def folds(rows: DataFrame, season: str = "season", least: int = LEAST_SEASONS) -> list[int]:
    """Seasons with enough earlier ones; the list is as long as there are seasons."""
    return sorted(r[0] for r in rows.select(season).distinct().collect())[least:]


def fitted(train: DataFrame, features: list[str], label: str, kind: str = "logistic", **settings) -> PipelineModel:
    makers = {
        "logistic": lambda: LogisticRegression(featuresCol="_inputs", labelCol=label, **({"regParam": 0.0, "standardization": False} | settings)),
        "gbt": lambda: GBTClassifier(featuresCol="_inputs", labelCol=label, **({"maxIter": 10, "maxDepth": 4, "seed": 5} | settings)),
        "gbt_regression": lambda: GBTRegressor(featuresCol="_inputs", labelCol=label, **({"maxIter": 10, "maxDepth": 4, "seed": 5} | settings)),
        "linear": lambda: LinearRegression(featuresCol="_inputs", labelCol=label, **settings),
        "binomial": lambda: GeneralizedLinearRegression(featuresCol="_inputs", labelCol=label, family="binomial", link="logit", **settings),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_inputs"), makers[kind]()]).fit(train)


def scored(model: PipelineModel, rows: DataFrame, out: str = "p") -> DataFrame:
    done = model.transform(rows)
    if "probability" in done.columns:
        done = done.withColumn(out, vector_to_array("probability")[1])
    else:
        done = done.withColumn(out, F.col("prediction"))
    return done.select(*rows.columns, out)


def calibrated(model: PipelineModel, held: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """rows with p mapped by an isotonic fit on held-back rows, within bounds."""
    iso = IsotonicRegression(featuresCol="p", labelCol=label).fit(scored(model, held))
    mapped = iso.transform(scored(model, rows)).withColumn("p", F.least(F.lit(HIGH), F.greatest(F.lit(LOW), F.col("prediction"))))
    return mapped.drop("prediction")


def walk_forward(rows: DataFrame, features: list[str], label: str, order: list[str], season: str = "season", kind: str = "logistic", calibrate: bool = True) -> DataFrame:
    """Predictions of each season by a model of the seasons before it; the last part of each of those calibrates."""
    sizes = rows.groupBy(F.col(season).alias("_s")).agg(F.count("*").alias("_n"))
    placed = numbered(rows, *order, name="_i", by=[season]).join(sizes, F.col(season) == F.col("_s"))
    last = F.col("_i") - 1 > FIT_SHARE * (F.col("_n") - 1)
    rows = written(placed.select(*rows.columns, last.alias("_held")), "folds")  # each fold reads it
    out = None
    for s in folds(rows, season):
        before, now = rows.filter(F.col(season) < s), rows.filter(F.col(season) == s).drop("_held")
        if calibrate:
            one = calibrated(fitted(before.filter("not _held"), features, label, kind), before.filter("_held"), now, label)
        else:
            one = scored(fitted(before, features, label, kind), now)
        out = one if out is None else out.unionByName(one)
    return out


def random_settings(space: dict[str, list], n: int, seed: int = 0) -> list[dict]:
    """n different settings drawn from the lists of space, or all of them where there are no more; equal seeds give equal draws."""
    names = sorted(space)
    size = math.prod(len(space[k]) for k in names)
    out = []
    for i in random.Random(seed).sample(range(size), min(n, size)):
        one = {}
        for k in names:
            i, j = divmod(i, len(space[k]))
            one[k] = space[k][j]
        out.append(one)
    return out


def swept(rows: DataFrame, features: list[str], label: str, settings: list[dict], season: str = "season", kind: str = "logistic", least: int = LEAST_SEASONS, least_rows: int = 100, side_by_side: int = 4) -> DataFrame:
    """season, setting (its place in settings), trained_on, n, log_loss, accuracy: each setting fitted before each season and scored on it.

    A setting is a dict of the model's own parameters and ``window``: how many seasons before the scored one are seen (None: all). A season needs ``least`` earlier seasons, and a fit ``least_rows``
    rows, else it has no row. Fits are jobs that run side by side; a season's rows pass once through all its models, and all scores come from one aggregation.
    """
    rows = written(rows.select(*dict.fromkeys([season, *features, label])), "sweep")  # every fit reads it
    sizes = {r[0]: r[1] for r in rows.groupBy(season).agg(F.count("*")).collect()}  # a row a season
    seasons = sorted(s for s in sizes if s is not None)
    low = lambda s, w: s - w if w is not None else seasons[0]
    seen = lambda s, w: sum(sizes[x] for x in seasons if low(s, w) <= x < s)
    cells = [(s, i) for s in seasons[least:] for i, one in enumerate(settings) if seen(s, one.get("window")) >= least_rows]

    def fit(cell: tuple) -> PipelineModel:
        s, i = cell
        own = {k: v for k, v in settings[i].items() if k != "window"}
        return fitted(rows.filter((F.col(season) < s) & (F.col(season) >= low(s, settings[i].get("window")))), features, label, kind, **own)

    with ThreadPoolExecutor(side_by_side) as pool:
        models = dict(zip(cells, pool.map(fit, cells), strict=True))
    parts = []
    for s in sorted({s for s, _ in cells}):
        part, mine = rows.filter(F.col(season) == s), [i for x, i in cells if x == s]
        for i in mine:
            part = scored(models[s, i], part, f"_p{i}")
        found = F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(seen(s, settings[i].get("window"))).cast("long").alias("trained_on"), F.col(f"_p{i}").alias("p")) for i in mine])
        parts.append(part.select(season, F.col(label).alias("_y"), F.explode(found).alias("c")).select(season, "_y", "c.*"))
    if not parts:
        return rows.sparkSession.createDataFrame([], T.StructType([rows.schema[season], *T._parse_datatype_string("setting int, trained_on bigint, n bigint, log_loss double, accuracy double")]))
    p = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), F.col("p")))
    hit = F.when((F.col("p") >= 0.5) == (F.col("_y") == 1), 1.0).otherwise(0.0)
    return reduce(DataFrame.unionByName, parts).groupBy(season, "setting", "trained_on").agg(F.count("*").alias("n"), F.avg(-F.ln(F.when(F.col("_y") == 1, p).otherwise(1 - p))).alias("log_loss"), F.avg(hit).alias("accuracy"))


def sweep_summary(scores: DataFrame, season: str = "season") -> DataFrame:
    """setting, seasons, log_loss, accuracy, trained_on (means over the seasons that every setting has) and wins: in how many of them it was best, the lower setting among equals."""
    whole = scores.groupBy(season).agg(F.count("*").alias("_n"))
    most = whole.agg(F.max("_n").alias("_m"))
    common = scores.join(whole.join(F.broadcast(most), F.col("_n") == F.col("_m")).select(season), season, "left_semi")  # most is one row
    best = common.groupBy(season).agg(F.min_by("setting", F.struct("log_loss", "setting")).alias("setting")).groupBy("setting").agg(F.count("*").alias("wins"))
    means = common.groupBy("setting").agg(F.count("*").alias("seasons"), *[F.avg(c).alias(c) for c in ("log_loss", "accuracy", "trained_on")])
    return means.join(best, "setting", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def symmetrised(forward: Column, reverse: Column, kind: str = "chance") -> Column:
    """One value from both orders of the sides: a chance and its complement, a common total, or a signed spread."""
    return {"chance": (forward + 1 - reverse) / 2, "total": (forward + reverse) / 2, "spread": (forward - reverse) / 2}[kind]


def residual_chance(rows: DataFrame, by: str, pred: str, actual: str, line: str, cells: int = 6, least: int = 500, fit: DataFrame | None = None) -> DataFrame:
    """rows with p_over: the share of a cell's residuals above line - pred; small cells use their group's, small groups all.

    Residuals are those of fit (by, pred, actual), or of rows where it is None. A cell is a group and a quantile range of fit's predictions; where there
    is no residual at all p_over is null. Residuals are counted by cell and value once; only the counts go to the
    pools that are asked for. Counts and the different values that are asked then run in one order, in ranges, so no row meets another, no pool is one task and
    a value that many rows ask for is one row; answers go back to the rows by pool and value.
    """
    fit = rows if fit is None else fit
    at = {f"_q{i}": i / cells for i in range(1, cells)}
    edges = written(quantiles(fit, pred, at, [by]).select(by, F.array(*at).alias("edges")), "edges")  # a row a group, read on both sides
    celled = lambda x: x.join(edges, by, "left").withColumn("cell", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col(pred))), F.lit(0))).drop("edges")
    known = celled(rows)
    counts = written(celled(fit).groupBy(by, "cell", (F.col(actual) - F.col(pred)).alias("v")).agg(F.count("*").alias("c")), "residuals")
    sizes = counts.groupBy(by, "cell").agg(F.sum("c").alias("n_cell"))
    asked = known.select(by, "cell").distinct().join(sizes, [by, "cell"], "left").join(sizes.groupBy(by).agg(F.sum("n_cell").alias("n_group")), by, "left")  # a row a cell
    level = F.when(F.col("n_cell") >= least, F.concat_ws("/", F.col(by).cast("string"), F.col("cell").cast("string"))).when(F.col("n_group") >= least, F.col(by).cast("string")).otherwise("*")
    asked = asked.withColumn("pool", level)
    pools = F.array(F.concat_ws("/", F.col(by).cast("string"), F.col("cell").cast("string")), F.col(by).cast("string"), F.lit("*"))
    residuals = counts.select(F.explode(pools).alias("pool"), "v", "c").join(asked.select("pool").distinct(), "pool", "left_semi").groupBy("pool", "v").agg(F.sum("c").alias("c"))
    pooled = known.join(asked.select(by, "cell", "pool"), [by, "cell"]).withColumn("_v", F.col(line) - F.col(pred))
    queries = pooled.select("pool", F.col("_v").alias("v")).distinct().select("pool", "v", F.lit(0).cast("long").alias("c"), F.lit(True).alias("_asks"))
    both = residuals.select("pool", "v", "c", F.lit(False).alias("_asks")).unionByName(queries)
    placed = running_totals(both, ["v", "_asks"], {"below": F.col("c")}, ["pool"]).filter("_asks").join(residuals.groupBy("pool").agg(F.sum("c").alias("size")), "pool", "left")
    p = 1 - F.col("below") / F.col("size")
    bounded = F.when(p.isNotNull(), F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p)))
    answers = written(placed.select(F.col("pool").alias("_pool"), F.col("v").alias("_asked"), bounded.alias("p_over")), "answers")  # of a size that is known when it is joined
    return pooled.join(answers, (F.col("pool") == F.col("_pool")) & F.col("_v").eqNullSafe(F.col("_asked")), "left").select(*rows.columns, "p_over")


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, w, z of the signed-rank test on paired values, with average ranks and a normal approximation."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0").withColumn("m", F.abs("d"))
    counts = d.groupBy("m").agg(F.count("*").alias("c"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"))
    ranked = running_totals(counts, ["m"], {"before": F.col("c")}).select("c", "up", (F.col("before") + (F.col("c") + 1) / 2).alias("rank"))
    sums = ranked.agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"))
    n = F.col("n").cast("double")  # its third power is beyond a long from 1.7 million pairs on
    return sums.select("n", F.round("w", 4).alias("w"), F.round((F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 6).alias("z"))
