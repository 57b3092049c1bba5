"""Known values of the scalar functions, devigging and the scoring chain."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.functions import market as mk
from rallyframe.functions import probability as prob
from rallyframe.functions import text as tx


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


@pytest.mark.parametrize(
    ("score", "status", "n_sets", "games", "margin", "ties", "usable"),
    [
        ("6-1 7-5", "completed", 2, 19, 7, 0, True), ("6-7(9) 7-6(3) 7-6(11)", "completed", 3, 39, 1, 3, True), ("2-6 6-4 3-6 6-2 7-5", "completed", 5, 47, 1, 0, True),
        ("6-2 4-1 RET", "retired", 2, 13, 7, 0, False), ("6-2 W/O", "walkover", 0, 0, 0, 0, False), (" w o ", "walkover", 0, 0, 0, 0, False), ("7-6(2) 1-0 def", "default", 2, 14, 2, 1, False), ("", "unfinished", 0, 0, 0, 0, False),
        (None, "unfinished", 0, 0, 0, 0, False), ("31-29 6-4", "completed", 1, 10, 2, 0, False), ("6-3 6-2 zz", "completed", 2, 17, 7, 0, False), ("6-3 6-2 4-6", "completed", 3, 27, 5, 0, False),
        ("6-1 6-2 5-7 4-6 6-3 7-5", "completed", 6, 58, 10, 0, False), ("3-6 6-1 [10-7]", "completed", 3, 33, 5, 0, True), ("7-6 6-7 7-6", "completed", 3, 39, 1, 0, True), ("6-4 UNFINISHED", "unfinished", 1, 10, 2, 0, False),
        ("45-0", "unfinished", 0, 0, 0, 0, False), ("6-4", "completed", 1, 10, 2, 0, False),
    ],
)
def test_scores(spark, score, status, n_sets, games, margin, ties, usable):
    """Expected values follow the rules as with_score states them."""
    got = tx.with_score(spark.createDataFrame([(score,)], "score string"), "score").first()
    assert (got["status"], got["n_sets"], got["games"], got["margin"], got["tiebreaks"], got["usable"]) == (status, n_sets, games, margin, ties, usable)


def test_names(spark):
    keys = {"Mira Tolvaj": "tolvaj|m", "Tolvaj M.": "tolvaj|m", "De La Vega-Ruiz P. Q.": "ruiz|p", "Orlan": "orlan", "J K": "j", "": "", " . ": "", None: "", "Ǎdám Šor": "sor|a", "Łoś": "łos"}
    rows = spark.createDataFrame([(k,) for k in keys], "n string").select("n", tx.surname_key(F.col("n")).alias("k"))
    assert {r.n: r.k for r in rows.collect()} == keys
    got = one(spark, d=tx.plain_name(F.lit("  Anne-Sofí   D'Arbó-Ñuz. ")), e=tx.slug(F.lit("-Córdoba Ñandú  / C-")), f=tx.plain_name(F.lit(None).cast("string")))
    assert got == {"d": "anne sofi darbo nuz", "e": "cordoba-nandu-c", "f": ""}


@pytest.mark.parametrize(("p", "hold"), [(0.50, 0.5), (0.60, 0.7357), (0.65, 0.8296), (0.70, 0.9008), (0.75, 0.9492)])
def test_hold(spark, p, hold):
    assert one(spark, h=prob.game(F.lit(p)))["h"] == pytest.approx(hold, abs=5e-4)


def test_sets_and_tiebreaks_are_fair_and_complementary():
    grid = np.linspace(0.4, 0.9, 13)
    a, b = (x.ravel() for x in np.meshgrid(grid, grid))
    for f in (prob.tiebreak_of, lambda x, y: prob.tiebreak_of(x, y, 10), prob.set_of, lambda x, y: prob.set_of(x, y, False)):
        p = f(a, b)
        assert ((p > 0) & (p < 1)).all()
        assert f(grid, grid) == pytest.approx(0.5, abs=1e-9)
        assert p + f(b, a) == pytest.approx(1, abs=1e-9)


PRICES = [(1.17, 5.40), (1.86, 1.99), (1.04, 13.5), (2.66, 1.49), (1.57, 2.95)]


@pytest.mark.parametrize(("a", "b"), PRICES)
def test_shin_closed_form_solves_the_model(spark, a, b):
    got = one(spark, p=mk.shin(F.lit(a), F.lit(b)), z=mk.shin_z(F.lit(a), F.lit(b)), k=mk.power(F.lit(a), F.lit(b)), o=mk.proportional(F.lit(a), F.lit(b)))
    total, z = 1 / a + 1 / b, got["z"]
    if total >= 1:
        side = lambda pi: ((z * z + 4 * (1 - z) * pi * pi / total) ** 0.5 - z) / (2 * (1 - z))
        assert side(1 / a) + side(1 / b) == pytest.approx(1, abs=1e-9)
        assert side(1 / a) == pytest.approx(got["p"], abs=1e-9)
    else:
        assert got["p"] == got["o"]
    assert 0 < got["k"] < 1


def test_fair_prices_keep_their_chances(spark):
    got = one(spark, a=mk.shin(F.lit(4.0), F.lit(4 / 3)), b=mk.power(F.lit(4.0), F.lit(4 / 3)), c=mk.proportional(F.lit(2.0), F.lit(2.0)))
    assert got == pytest.approx({"a": 0.25, "b": 0.25, "c": 0.5}, abs=1e-9)


def test_season_cut(spark):
    from rallyframe.operators.form import season_of

    rows = spark.createDataFrame([("2024-12-18",), ("2024-12-29",), ("2025-12-25",)], "d string").select(season_of(F.col("d").cast("date")).alias("s"))
    assert [r.s for r in rows.collect()] == [2024, 2025, 2026]
