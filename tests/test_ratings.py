"""Ratings that regress at changes of season, and questions about their history."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import ratings

SCHEMA = "pool string, match_id bigint, day int, surface string, winner_id bigint, loser_id bigint, margin double, walkover boolean, season bigint"


def results(n=300):
    random.seed(6)
    rows, season = [], 2000
    for m in range(n):
        season += random.random() < 0.03
        a, b = random.sample(range(12), 2)
        rows.append(("ab"[m % 2], m, m * 2, random.choice("xy"), a, b, float(m % 7), m % 37 == 5, season))
    return rows


def eager(rows, rule):
    """(before each match, after any number of matches) with all ratings moved at each change of season; overall ratings only."""
    out, r, n, last = {}, {}, {}, {}
    history = []
    for pool, m, _, _, w, x, _, walkover, season in rows:
        if last.get(pool, season) != season:
            for k in r:
                if k[0] == pool:
                    r[k] = rule.base + (r[k] - rule.base) * (1 - rule.season_regress)
        last[pool] = season
        a, b = r.get((pool, w), rule.base), r.get((pool, x), rule.base)
        out[m] = (a, b)
        history.append((dict(r), dict(n)))
        if walkover:
            continue
        move = 1 - 1 / (1 + 10 ** ((b - a) / 400))
        for p, own, sign in ((w, a, 1), (x, b, -1)):
            k = (pool, p)
            r[k] = own + sign * rule.k_scale / (n.get(k, 0) + rule.k_offset) ** rule.k_power * move
            n[k] = n.get(k, 0) + 1
    return out, history


RULE = ratings.EloRule(idle_rate=0.0, season_regress=0.4)


def test_lazy_seasons_equal_eager_ones(spark):
    rows = results()
    got = ratings.elo(spark.createDataFrame(rows, SCHEMA).repartition(3), ["pool"], RULE).collect()
    want, _ = eager(rows, RULE)
    assert {r.match_id: (pytest.approx(r.w_elo), pytest.approx(r.l_elo)) for r in got} == want


@pytest.mark.parametrize("cut", [1, 90, 200])
def test_seasons_resumed_equal_the_full_fold(spark, cut):
    rows = spark.createDataFrame(results(), SCHEMA)
    full = {r.match_id: r for r in ratings.elo(rows, ["pool"], RULE).collect()}
    state = ratings.elo_state(rows.filter(F.col("match_id") < cut), ["pool"], RULE)
    later = ratings.elo(rows.filter(F.col("match_id") >= cut), ["pool"], RULE, state=state).collect()
    assert len(later) == 300 - cut
    for r in later:
        assert tuple(r)[2:] == pytest.approx(tuple(full[r.match_id])[2:])


def test_questions_are_answered_before_their_match(spark):
    rows = results()
    _, history = eager(rows, RULE)
    asked = [(pool, 1000 + m * 20 + p, m, p, "x", day, season) for pool, m, day, _, _, _, _, _, season in rows if m % 5 == 0 for p in (0, 3, 11, 19)]
    questions = spark.createDataFrame(asked, "pool string, ask_id bigint, match_id bigint, player_id bigint, surface string, day int, season bigint")
    got = {r.ask_id: r for r in ratings.elo_asked(spark.createDataFrame(rows, SCHEMA), questions, ["pool"], RULE).collect()}
    assert len(got) == len(asked) and got[1019].elo == RULE.base and got[1019].played == 0
    for pool, ask, m, p, _, _, _ in asked:
        r, n = history[m]
        assert got[ask].elo == pytest.approx(r.get((pool, p), RULE.base)) and got[ask].played == n.get((pool, p), 0), m


def test_state_of_many_players_is_small_and_leaves_as_it_is_read():
    import tracemalloc

    pool = ratings._Pool(ratings.EloRule())
    tracemalloc.start()
    for m in range(20_000):
        for surface in "xy":
            pool.fold(2 * m, 2 * m + 1, surface, m, 1.0)
    held = tracemalloc.get_traced_memory()[0]
    end = iter(pool.end())
    first = next(end)
    assert 1 + sum(1 for _ in end) == 3 * 40_000 and first[5:7] == (0, None)
    assert held < 250 * 40_000  # bytes a player with three ratings
    tracemalloc.stop()
