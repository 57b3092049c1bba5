"""Ratings without leakage, as-of joins, brackets, sources and table maintenance on small frames."""

from __future__ import annotations

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import market as mk
from rallyframe.operators import bracket, metrics, models, ordering, ratings
from rallyframe.operators import relational as rel
from rallyframe.plans.values import pooled
from rallyframe.sources import drawsheets, files, pages
from rallyframe.streaming import flows


def test_ratings_of_a_prefix_do_not_change(spark, sf_dir):
    rows = pooled(spark, sf_dir)
    half = rows.agg(F.percentile("match_id", 0.5)).first()[0]
    whole = {r.match_id: r for r in ratings.elo(rows, ["pool"]).filter(F.col("match_id") <= half).collect()}
    part = {r.match_id: r for r in ratings.elo(rows.filter(F.col("match_id") <= half), ["pool"]).collect()}
    assert whole == part and len(part) > 50


def test_first_match_has_base_ratings_and_idle_players_drift(spark):
    rows = spark.createDataFrame([("a", 1, 0, "s", 1, 2, 3.0, False), ("a", 2, 455, "s", 1, 2, 3.0, False)], "pool string, match_id bigint, day int, surface string, winner_id bigint, loser_id bigint, margin double, walkover boolean")
    got = ratings.elo(rows, ["pool"]).orderBy("match_id").collect()
    assert (got[0].w_elo, got[0].l_elo) == (1500, 1500)
    k = 200 / 5**0.4 / 2
    assert got[1].w_elo == pytest.approx(1500 + k * 0.75)  # a year beyond the grace of 90 days


def test_as_of_takes_the_last_earlier_value(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 1, "z")], "k int, t int, id string")
    right = spark.createDataFrame([(1, 3, 30), (1, 4, 40), (1, 5, 50)], "k int, t int, v int")
    assert {r.id: r.v for r in rel.as_of(left, right, "k", "t", "t", ["v"]).collect()} == {"x": 40, "y": None, "z": None}
    assert {r.id: r.v for r in rel.as_of(left, right, "k", "t", "t", ["v"], strict=False).collect()} == {"x": 50, "y": 30, "z": None}


def test_upsert_matches_null_keys(spark):
    old = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    new = spark.createDataFrame([(None, 9)], "k int, v int")
    assert {(r.k, r.v) for r in rel.upsert(old, new, ["k"], F.lit(0)).collect()} == {(None, 9), (2, 2)}


def test_title_chances_sum_to_one_with_byes(spark):
    draws = spark.createDataFrame([(1, i, 100 + i, float(i)) for i in range(5)], "draw_id int, slot int, player_id int, strength double")
    out = bracket.advancement(bracket.padded(draws), lambda a, b: 1 / (1 + F.exp((b - a) / 4)), 3)
    assert out.filter("player_id is not null").agg(F.sum("reach_3")).first()[0] == pytest.approx(1)
    assert bracket.rounds_of(8) == ["QF", "SF", "F"]


def test_draws_are_rebuilt_from_results(spark):
    draws = spark.createDataFrame([(1, i, 100 + i, float(i)) for i in range(8)], "draw_id int, slot int, player_id int, strength double")
    results = bracket.simulate(draws, lambda a, b: F.lit(0.5), 3, 1)
    rebuilt = {r.player_id: r.slot // 2 for r in bracket.reconstructed(results, 3).collect()}
    assert len(rebuilt) == 8 and all(rebuilt[100 + 2 * i] == rebuilt[101 + 2 * i] for i in range(4))


def listed(ts, link, names, *prices):
    cells = "".join(f'<td class="num"> <b> {x} </b> </td>' for x in prices)
    return f'<TR id="r{link}"><td><span ts="{ts}">soon</span><a class="m" href="/m/{link}">{names}</a></td>{cells}</TR>'


def test_listing(spark):
    rows = [
        listed(86399, 1, "Quill Aster - Bo Tern", 1.09, 8), listed(86400, 2, "  One-Two Fir  -  Elm Oak ", "2", "1.84", "9.9"),
        listed(5, 3, "Only One Name", 1.5, 2.5), listed(6, 4, "A - B - C", 1.5, 2.5), listed(7, 5, "Ash - Bay", 1.5), listed("", 6, "Ash - Bay", 1.5, 2.5), listed(8, 7, " - Bay", 1.5, 2.5),
    ]
    got = pages.listing(spark.createDataFrame([(7, "<table>" + "".join(rows)), (8, ""), (9, None)], "page_id int, html string")).orderBy("ts").collect()
    assert [(r.page_id, r.href, r.p1_name, r.p2_name, r.p1_odds, r.p2_odds, r.day) for r in got] == [(7, "/m/1", "Quill Aster", "Bo Tern", 1.09, 8.0, 19700101), (7, "/m/2", "One-Two Fir", "Elm Oak", 2.0, 1.84, 19700102)]


def test_fixtures_in_two_rows(spark):
    head = '<tr class="x head"><td class="t-name">{}</td></tr>'
    first = '<tr class="a"><td class="time c2">{}</td><td class="t-name">{}</td>{}</tr>'
    second = '<tr class="b"><td class="t-name">{}</td></tr>'
    priced = '<td class="course">3.05</td><td class="coursew">1.33</td>'
    html = head.format("Port Open") + first.format("09:05", "Fern P. (12)", priced) + second.format("Moss <i>Q.</i>") + head.format("Lake Cup") + first.format("23:59", "Reed S.", "") + second.format("Sedge T. (3)")
    got = pages.fixtures(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("start_time").collect()
    assert [(r.tournament, r.start_time, r.p1_name, r.p2_name, r.p1_odds, r.p2_odds) for r in got] == [("Port Open", "09:05", "Fern P.", "Moss Q.", 3.05, 1.33), ("Lake Cup", "23:59", "Reed S.", "Sedge T.", None, None)]


def test_quotes_with_and_without_history(spark):
    def cell(k, close, *history):
        moves = "".join(f'<tr><td>{at}</td><td class="bold">{x}</td></tr>' for at, x in history[:-1])
        opened = f'<tr><td>Opening odds</td></tr><tr><td>{history[-1][0]}</td><td class="bold">{history[-1][1]}</td></tr>' if history else ""
        return f'<td class="k{k}"><div class="odds-in">{close}<table>{moves}{opened}</table></div></td>'

    def book(name, *cells):
        return f'<tr class="row"><td><span class="t">{name}</span></td>{"".join(cells)}</tr>'

    def table(heading, *books):
        return f'<table><tr><th colspan="4">{heading}</th></tr>{"".join(books)}</table>'

    html = (
        table("Over/Under 22.5 games", book("Lark", cell(1, 1.71, ("03.04. 10:00", 1.71), ("02.04. 08:30", 1.88)), cell(2, 2.12)), book("Wren", cell(1, 1.69), cell(2, 2.2)))
        + table("Asian Handicap +2.5 sets", book("Lark", cell(1, 3.3), cell(2, "-"))) + table("Something else", book("Lark", cell(1, 9), cell(2, 9)))
    )
    got = {(r.book, r.market, r.line, r.line_unit, r.side): (r.price_close, r.closed_at, r.price_open, r.opened_at) for r in pages.quotes(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()}
    assert got == {
        ("Lark", "totals", 22.5, "games", "over"): (1.71, "03.04. 10:00", 1.88, "02.04. 08:30"), ("Lark", "totals", 22.5, "games", "under"): (2.12, None, None, None),
        ("Wren", "totals", 22.5, "games", "over"): (1.69, None, None, None), ("Wren", "totals", 22.5, "games", "under"): (2.2, None, None, None), ("Lark", "handicap", 2.5, "sets", "p1"): (3.3, None, None, None),
    }


def test_draw_sheet(spark):
    bye = drawsheets.BYE
    player = lambda i, **more: {"id": i, "name": f"P{i}"} | more
    ties = [
        {"roundId": 3, "draw": 1, "result": "Bye", "player1Id": 11, "player1": player(11, seed="2")}, {"roundId": 3, "draw": 2, "player1Id": bye, "player2Id": 12, "seed2": "7", "player1": player(bye), "player2": player(12)},
        {"roundId": 3, "draw": 3, "result": "", "player1": player(13), "player2": player(14)}, {"roundId": 3, "draw": 4, "player1": player(15)}, {"roundId": 4, "draw": 1, "player1": player(11), "player2": player(12)},
    ]
    sheets = spark.createDataFrame([(1, json.dumps({"data": {"singles": ties}})), (2, "no json"), (3, None), (4, "{}")], "draw_id int, payload string")
    got = [(r.slot, r.player_id, r.seed, r.is_bye) for r in drawsheets.first_round(sheets).orderBy("slot").collect()]
    assert got == [(0, 11, "2", False), (1, None, None, True), (2, 12, "7", False), (3, None, None, True), (4, 13, None, False), (5, 14, None, False), (6, 15, None, False), (7, None, None, False)]


def test_pairs_anywhere(spark):
    payload = {"a": [{"Player1": {"p1": 1, "p2": 2}, "PLAYER2": "x"}, {"deep": {"P1": 5, "p2": None}}], "p1": 3}
    rows = spark.createDataFrame([(1, json.dumps(payload)), (2, "["), (3, None)], "draw_id int, payload string")
    assert sorted((r.path, r.player1, r.player2) for r in drawsheets.matches_anywhere(rows).collect()) == [("$.a[0]", '{"p1": 1, "p2": 2}', '"x"'), ("$.a[1].deep", "5", "null")]


def test_serve_ratings_share_a_surface_sample(spark):
    schema = "pool string, match_id bigint, surface string, winner_id bigint, loser_id bigint, w_points double, w_won double, l_points double, l_won double"
    rows = [("a", 1, "s", 1, 2, 80.0, 60.0, 100.0, 55.0), ("a", 2, "s", 1, 2, float("inf"), 1.0, 1.0, 1.0), ("a", 3, "s", 1, 2, 50.0, 30.0, 50.0, 30.0), ("a", 4, "t", 1, 2, None, 1.0, 1.0, 1.0)]
    got = {r.match_id: r for r in ratings.serve_return(spark.createDataFrame(rows, schema), ["pool"], 0.6).collect()}
    assert (got[1].w_serve, got[1].l_return) == (0, 0) and got[2][2:] == got[3][2:]
    move, back = 0.04 * (60 / 80 - 0.6) * 0.8, -0.04 * (55 / 100 - 0.6) * 1.0
    w = 0.35 * 180 / 580  # both kinds of points are one sample of a surface
    assert got[3].w_serve == pytest.approx((1 - w) * move * 80 / 480 + w * move * 180 / 580)
    assert got[3].w_return == pytest.approx((1 - w) * back * 100 / 500 + w * back * 180 / 580)
    assert got[4].w_serve != got[3].w_serve


def test_resumed_ratings_equal_a_full_fold(spark, sf_dir):
    rows = pooled(spark, sf_dir)
    cut = rows.agg(F.percentile("match_id", 0.3)).first()[0]
    state = ratings.elo_state(rows.filter(F.col("match_id") <= cut), ["pool"])
    later = {(r.pool, r.match_id): r for r in ratings.elo(rows.filter(F.col("match_id") > cut), ["pool"], state=state).collect()}
    full = {(r.pool, r.match_id): r for r in ratings.elo(rows, ["pool"]).filter(F.col("match_id") > cut).collect()}
    assert later == full and len(full) > 100


def test_running_totals_by_group(spark):
    rows = [(g, i, i * (1 if g else 2)) for g in (None, 0, 1) for i in range(300)]
    got = ordering.running_totals(spark.createDataFrame(rows, "g int, i int, v int").repartition(7), ["i"], {"t": F.col("v"), "n": F.lit(1)}, ["g"]).collect()
    assert len(got) == 900 and all(r.n == r.i and r.t == sum(range(r.i)) * (1 if r.g else 2) for r in got)


def test_sessions_and_first_rows_over_several_batches(spark, tmp_path):
    events = spark.createDataFrame(
        [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 20:00:00"), (3, 1, "2024-01-01 10:00:00"), (4, 2, "2024-01-03 00:00:00"), (5, 1, "2024-01-05 00:00:00")], "event_id int, user_id int, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(1, 6):  # the third file joins the sessions of the first two
        events.filter(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    rows = flows.run_now(flows.editions(stream, "12 hours"), f"file://{tmp_path}/s", "complete")
    assert rows.select("batch").distinct().count() >= 5
    assert sorted((r.user_id, r.n) for r in flows.newest(rows).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_walk_forward_sees_only_earlier_seasons(spark):
    rows = [(s, i, float(i % 10), float((i % 10 >= 5) != (s == 3))) for s in range(5) for i in range(200)]  # the rule is turned round in season 3
    out = models.walk_forward(spark.createDataFrame(rows, "season int, i int, level double, label double"), ["level"], "label", ["i"])
    got = {r.season: r.hit for r in out.groupBy("season").agg(F.avg(F.when((F.col("p") > 0.5) == (F.col("label") == 1), 1.0).otherwise(0.0)).alias("hit")).collect()}
    assert set(got) == {2, 3, 4} and got[2] == 1.0 and got[3] == 0.0 and got[4] == 1.0
    assert out.filter("p < 0.01 or p > 0.99").count() == 0


def test_results_files(spark, tmp_path):
    header = ",".join(files.RESULTS.names)

    def line(**values):
        return ",".join(str(values.get(c, "")) for c in files.RESULTS.names)

    good = dict(tourney_id="t", tourney_level="G", indoor="I", round="F", winner_id="a", loser_id="b", tourney_date="20240105", score="6-4 6-3", winner_rank="x", w_svpt=50, l_svpt=60, w_SvGms=9)
    for name, rows in {"2024.csv": [line(**good), line(**good | {"loser_id": "a"}), line(**good | {"tourney_date": "bad"})], "_skip2024.csv": [line(**good)], "1999.csv": [line(**good)], "2024_chall.csv": [line(**good | {"match_num": 2})]}.items():
        (tmp_path / name).write_text("\n".join([header, *rows]) + "\n")
    rows = files.in_play_order(files.cleaned(files.results(spark, f"{tmp_path}/*.csv"))).orderBy("seq").collect()
    assert [(r.source_file, r.level, r.season, r.indoor, r.games, r.winner_rank, r.has_stats, r.seq) for r in rows] == [
        ("2024_chall.csv", "challenger", 2024, 1, 19, None, True, 1), ("2024.csv", "slam", 2024, 1, 19, None, True, 2),
    ]
    with pytest.raises(ValueError):
        files.replace_table(spark.range(0), f"file://{tmp_path}/out")
    with pytest.raises(ValueError):
        files.current_table(spark, f"file://{tmp_path}/out")


def test_files_of_several_headers(spark, tmp_path):
    (tmp_path / "2001.csv").write_text("winner_id,loser_id,tourney_date,score,odd\na,b,20010203,6-1 6-1,\"x,y\"\n")
    (tmp_path / "2002 b.csv").write_text("score,tourney_date,loser_id,winner_id,indoor\n6-2 6-2,20020203,d,c,I\n")
    (tmp_path / "2003.csv").write_text("winner_id,loser_id,tourney_date,score,odd\ne,f,20030203,6-3 6-3,\n")
    (tmp_path / "2004.csv").write_text("")
    rows = files.cleaned(files.results(spark, f"file://{tmp_path}/*.csv")).collect()
    assert sorted((r.winner_id, r.loser_id, r.games, r.indoor, r.season) for r in rows) == [("a", "b", 14, None, 2001), ("c", "d", 16, 1, 2002), ("e", "f", 18, None, 2003)]


def test_a_reload_that_fails_leaves_the_old_rows(spark, tmp_path):
    path, ids = f"file://{tmp_path}/t", lambda rows: sorted(r.id for r in rows.collect())
    old = files.replace_table(spark.range(5), path)
    for bad in (spark.range(0), spark.range(9).select(F.expr("assert_true(id < 3, 'no')").alias("x"), "id")):
        with pytest.raises(Exception):  # noqa: B017
            files.replace_table(bad, path)
    with pytest.raises(ValueError):
        files.replace_table(spark.range(9), path, check=lambda new: new.count() < 3)
    assert ids(files.current_table(spark, path)) == list(range(5)) and len(list((tmp_path / "t").glob("version-*"))) == 1
    files.replace_table(files.current_table(spark, path).filter("id > 1"), path)
    assert ids(files.current_table(spark, path)) == [2, 3, 4] and ids(old) == list(range(5))  # readers that have begun go on
    files.replace_table(spark.range(2), path)
    assert len(list((tmp_path / "t").glob("version-*"))) == 2
    parts = f"file://{tmp_path}/p"
    files.replace_table(spark.range(6).withColumn("part", F.col("id") % 3), parts, ["part"])
    got = files.replace_table(spark.createDataFrame([(100, 1)], "id bigint, part bigint"), parts, ["part"])
    assert sorted((r.id, r.part) for r in got.collect()) == [(0, 0), (2, 2), (3, 0), (5, 2), (100, 1)]


def test_names_find_the_player_seen_last(spark):
    from rallyframe.operators import relational

    players = [(1, "Ann Lee", 10), (2, "Ann Lee", 30), (3, "Amy Lee", 20), (4, "Dan Mer", 5), (5, "José Ñu-Paz", None), (6, None, 9), (7, "Solo", 1)]
    feed = [(1, "ann lee"), (2, "Lee A."), (3, "Dan Mer Aguilar"), (4, "Jose Nu Paz"), (5, "Nobody Here"), (6, None), (7, " "), (8, "SOLO"), (9, "Paz J."), (10, "ann lee")]
    rows = relational.resolved(spark.createDataFrame(feed, "id int, name string"), spark.createDataFrame(players, "player_id bigint, name string, last_seen int")).collect()
    assert {r.id: (r.player_id, r.level) for r in rows} == {1: (2, 0), 2: (2, 1), 3: (4, 2), 4: (5, 0), 5: (None, None), 6: (None, None), 7: (None, None), 8: (7, 0), 9: (5, 1), 10: (2, 0)}


def test_day_pages_with_odd_rows(spark):
    page = (
        '<table><tr class="flags head"><td class="t-name">River Cup</td></tr><tr class="a"><td class="t-name"><a>Ode B.</a> (2)</td><td class="score">2</td><td class="score">0</td><td class="course">x</td><td class="coursew">3.5</td><td><a href="/match-detail/?id=71">i</a></td></tr>'
        '<tr class="a"><td class="t-name">Pell C.</td></tr><tr class="b"><td class="t-name">No Link</td></tr><tr class="head"><td class="t-name">ITF Shore</td></tr><tr class="c"><td class="t-name">Q</td><td><a href="/match-detail/?id=72">i</a></td></tr><tr><td class="t-name">R</td></tr></table>'
    )
    rows = spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "<tr><td class='t-name'>")], "page_id int, html string")
    got = pages.day_results(rows).collect()
    assert [tuple(r) for r in got] == [(1, 71, "River Cup", "atp", "Ode B.", "Pell C.", "2 0", None, 3.5)]


def test_pinned_ties_settle_their_blocks(spark):
    draw = spark.createDataFrame([(1, i, i, 0.0) for i in range(4)], "draw_id int, slot int, player_id int, strength double")
    even = lambda a, b: 1 / (1 + F.exp(b - a))
    pins = spark.createDataFrame([(1, 1, 0, 1)], "draw_id int, round int, block int, winner int")
    got = {r.player_id: (r.reach_1, r.reach_2) for r in bracket.advancement(draw, even, 2, pins).collect()}
    assert got == {0: (0.0, 0.0), 1: (1.0, 0.5), 2: (0.5, 0.25), 3: (0.5, 0.25)}
    none = bracket.advancement(draw, even, 2, pins.limit(0)).collect()
    assert all(math.isclose(r.reach_2, 0.25) for r in none)


def test_residual_chances_from_earlier_rows(spark):
    fit = spark.createDataFrame([(1, 0.0, float(i)) for i in range(-50, 50)], "g int, pred double, actual double")
    asked = spark.createDataFrame([(1, 1, 10.0, 30.0), (2, 1, 10.0, 999.0), (3, 2, 0.0, 0.0)], "id int, g int, pred double, line double")
    got = {r.id: r.p_over for r in models.residual_chance(asked, "g", "pred", "actual", "line", least=10, fit=fit).collect()}
    assert math.isclose(got[1], 0.29) and math.isclose(got[2], 1e-6, rel_tol=1e-3) and math.isclose(got[3], 0.49)
    assert [r.p_over for r in models.residual_chance(asked, "g", "pred", "actual", "line", fit=fit.limit(0)).collect()] == [None] * 3


def test_ranks_share_ties_in_groups(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("b", 9.0)], "g string, x double")
    assert sorted((r.g, r.x, r.k) for r in metrics.ranked(rows, "x", ["g"], "k").collect()) == [("a", 1.0, 1.0), ("a", 3.0, 2.5), ("a", 3.0, 2.5), ("b", 9.0, 1.0)]


def test_no_chance_has_no_loss(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, None)], "y int, p double")
    loss = rows.agg(mk.log_loss(F.col("y"), F.col("p")).alias("l")).first().l
    assert math.isclose(loss, math.log(2))
    assert [r.k for r in rows.select(mk.kelly(F.col("p"), F.lit(3.0)).alias("k")).collect()] == [0.05, None]


def test_no_season_chooses_its_own_weight(spark):
    """Weight 10 is best in the first two seasons and the worst after that: each season goes by those before it."""
    from rallyframe.operators import betting

    rows = [(s, w, 200, 100.0 + (10 - w if s < 3 else 50 * w)) for s in (1, 2, 3, 4, 5) for w in (0, 5, 10)] + [(0, w, 50, 1.0) for w in (0, 5, 10)]
    got = {r.season: (r.weight, r.trained_on) for r in betting.expanding_best(spark.createDataFrame(rows, "season int, weight bigint, n bigint, loss double")).collect()}
    assert got == {2: (10, 250), 3: (10, 450), 4: (0, 650), 5: (0, 850)}


def test_table_function_on_odd_pages(spark):
    from rallyframe.sources import pages

    spark.udtf.register("book_prices_of", pages.BookPrices)
    cell = '<span class="toSort noDsp">{}</span>'
    book = '<div class="bookName"><a class="toSort" href="#">{}</a></div>'
    html = [None, "", "<p>no books", book.format("A") + cell.format(2.0) + cell.format(1.9), book.format("B") + cell.format(2.0), book.format("C") + cell.format(0) + cell.format(2), book.format("Bookmaker") + cell.format(2) + cell.format(2), book.format("D") + cell.format(9) + cell.format(9)]
    rows = spark.createDataFrame([*enumerate(html), (3, html[3])], "page bigint, html string")
    want = sorted((r.page_id, r.book, r.o1, r.o2) for r in pages.book_prices(rows.withColumnRenamed("page", "page_id")).collect())
    got = spark.sql("SELECT * FROM book_prices_of(TABLE({rows}) PARTITION BY page)", rows=rows).collect()
    assert sorted((r.page, r.book, r.o1, r.o2) for r in got) == want == [(3, "A", 2.0, 1.9), (3, "A", 2.0, 1.9)]


def test_a_pairing_is_one_fixture_however_often_it_is_listed(spark):
    from rallyframe.operators import betting

    rows = [("Ito U.", "Sato R.", 10, 3.8), ("Ito U.", "Sato R.", 12, 3.9), ("Sato R.", "Ito U.", 13, 1.3), ("Kolar S.", "May A.", 12, 2.4), ("Kolar S.", None, 14, 2.0), (None, None, 15, 2.0)]
    listed = spark.createDataFrame(rows, "a string, b string, captured int, odds double")
    assert sorted(betting.freshest_pairings(listed, "a", "b", "captured").collect()) == [("Kolar S.", "May A.", 12, 2.4), ("Sato R.", "Ito U.", 13, 1.3)]
    assert betting.freshest_pairings(listed.limit(0), "a", "b", "captured").count() == 0
    priced = spark.createDataFrame([(0.5, 2.0, 2.0), (0.2, 2.0, 2.0), (None, 2.0, 2.0), (0.5, 1.0, 1.0)], "p_model double, p1_price double, p2_price double")
    picks = [tuple(r) for r in betting.with_picks(priced).select("side", "price", "p_side", "ev", "stake").collect()]
    assert picks[0] == (1, 2.0, 0.5, 0.0, 0.0) and picks[1][:3] == (2, 2.0, 0.8) and picks[1][4] == 0.05 and picks[2] == (None,) * 5 and picks[3] == (1, 1.0, 0.5, -0.5, 0.0)


def test_exponential_means_of_any_batches_equal_a_fold(spark):
    import random

    from rallyframe.operators import form

    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None, "c"]), i, draw.choice([None, float("nan"), draw.gauss(0, 1), 3.0])) for i in range(700)] + [("long", i, draw.random()) for i in range(5000)]
    want, state = {}, {}
    for k, i, x in sorted(rows, key=lambda r: r[1]):
        for h in (5.0, 20.0):
            s, w = state.get((k, h), (0.0, 0.0))
            want[k, i, h] = s / w if w else None
            keep = 0.5 ** (1 / h)
            if x is not None and x == x:
                state[k, h] = s * keep + x * (1 - keep), w * keep + 1 - keep
    frame = spark.createDataFrame(rows, "k string, i int, x double")
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for k, i, fast, slow in form.ewma_before(frame if size != "3" else frame.filter("i < 700"), ["k"], "i", "x").collect():
            for h, got in ((5.0, fast), (20.0, slow)):
                assert got == want[k, i, h] or abs(got - want[k, i, h]) < 1e-9, (k, i, h)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert form.ewma_before(frame.limit(0), ["k"], "i", "x").count() == 0


def test_stages_of_a_run(spark):
    from rallyframe.operators import bracket

    far = spark.createDataFrame([(0,), (2,), (3,), (None,)], "rounds_won long")
    assert [tuple(r) for r in bracket.stages(far, 8).collect()] == [(0, "QF", "QF"), (2, "F", "F"), (3, "W", None), (None, None, None)]


def test_simulations_deal_draws_to_tasks_and_group_once(spark):
    """A few rows become many: they are spread before that, and no simulation is grouped by itself."""
    draws = spark.range(64 * 8).select((F.col("id") / 8).cast("int").alias("draw_id"), (F.col("id") % 8).cast("int").alias("slot"), F.when(F.col("id") % 8 < 6, F.col("id")).alias("player_id"), (F.col("id") % 8).cast("double").alias("strength"))
    results = bracket.simulate(draws, lambda a, b: 1 / (1 + F.exp((b - a) / 4)), 3, 20)
    assert results._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    assert results.withColumn("part", F.spark_partition_id()).select("part").distinct().count() > 1
    one = results.groupBy("draw_id", "sim").agg(F.count("*").alias("ties"), F.count("winner").alias("won"), F.count_if(F.col("round") == 3).alias("finals")).select("ties", "won", "finals").distinct().collect()
    assert [tuple(r) for r in one] == [(7, 6, 1)]  # the tie of two byes has no winner
    # who wins goes on: winners of a round are the sides of the next
    sides = results.filter("round > 1").select("draw_id", "sim", (F.col("round") - 1).alias("round"), F.explode(F.array("winner", "loser")).alias("winner")).filter("winner is not null")
    assert sides.join(results, ["draw_id", "sim", "round", "winner"], "left_anti").isEmpty()
    wins = bracket.frequencies(results, 20).groupBy("round").agg(F.sum("share").alias("s")).orderBy("round").collect()
    assert [round(r.s, 6) for r in wins] == [64 * 3, 64 * 2, 64]


def test_a_customer_may_have_the_number_of_the_bye(spark, tmp_path):
    from rallyframe.plans.captures import source_draw_sheet
    from rallyframe.sources import drawsheets

    n = drawsheets.BYE
    spark.range(n - 20, n + 20).select(F.col("id").alias("c_custkey"), F.lit(0.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    rows = source_draw_sheet(spark, str(tmp_path)).filter("player_id is not null").collect()
    assert sorted(r.player_id for r in rows) == list(range(n - 20, n + 20)) and all(r.name == f"Customer {r.player_id}" and not r.is_bye for r in rows)


def most_rows(df):
    """The most rows that any step of a plan gave out in its run."""
    done = df.select("*")
    done._jdf.queryExecution().executedPlan()
    done._jdf.collectToPython()
    plan, most = [done._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plan.append(node.plan())
        elif kind == "ReusedExchangeExec":
            continue
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


def test_band_join_does_not_pair_rows_that_share_a_key(spark):
    rng = random.Random(4)
    lefts = [(rng.randrange(3), 100 + rng.randrange(80), rng.randrange(40)) for _ in range(120)]
    rights = [(rng.randrange(3), 500 + rng.randrange(60), rng.randrange(40)) for _ in range(90)]
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))
    left = spark.createDataFrame(lefts, "k int, left_id long, d int").select("k", "left_id", day.alias("a"))
    right = spark.createDataFrame(rights, "k int, right_id long, d int").select("k", "right_id", day.alias("b"))
    for low, days in ((None, 3), (0, 5), (-2, 0)):
        lowest = -days if low is None else low
        first = {}
        for k, i, a in lefts:
            for k2, j, b in rights:
                if k == k2 and lowest <= b - a <= days:
                    first[i] = min(first.get(i, (999,)), (abs(b - a), j, b - a, k))
        second = {}
        for i, (g, j, gap, k) in first.items():
            second[j] = min(second.get(j, (999,)), (g, i, gap, k))
        got = rel.banded_nearest(left, right, ["k"], "a", "b", days, "left_id", "right_id", low)
        assert {(r.k, r.left_id, r.right_id, abs(r.gap)) for r in got.collect()} == {(k, i, j, g) for j, (g, i, gap, k) in second.items()}
    same = lambda side, c: spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias(side), F.lit("2024-01-01").cast("date").alias(c))
    one = rel.banded_nearest(same("left_id", "a"), same("right_id", "b"), ["k"], "a", "b", 7, "left_id", "right_id")
    assert [tuple(r) for r in one.collect()] == [(1, 0, 0, 0)] and most_rows(one) <= 4000


def test_book_prices_are_read_in_batches(spark):
    """A page is no partition and no call of its own: the function sees batches of pages."""
    from rallyframe.plans.captures import source_book_prices_udtf

    sizes = spark.range(40).select(F.lit('<div class="bookName">').alias("html"), F.col("id").alias("page"))
    calls = []
    real = pages.BookPrices.func
    for batch in [b for b in sizes.coalesce(1).toArrow().to_batches() if b.num_rows]:
        calls.append(sum(t.num_rows for t in real().eval(batch)))
    assert calls == [0]
    rows = source_book_prices_udtf(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that which makes the pages


def test_bootstrap_counts_are_those_of_the_uniforms(spark):
    from rallyframe.operators import betting

    rows = spark.range(20000)
    a, b = betting.poisson_count(7, F.col("id"), 3), betting.poisson_weight(betting.uniform(7, F.col("id"), 3))
    assert rows.filter(a != b).isEmpty() and rows.select(a.alias("k")).distinct().count() >= 6
    plan = betting.bootstrap(rows.select("id", F.lit(1.0).alias("v"), F.lit(1).alias("n")), "id", "v", "n", 5)._jdf.queryExecution().executedPlan().toString()
    assert "conv(" not in plan


def test_average_ranks_sort_once(spark):
    from rallyframe.operators import metrics

    rows = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0), ("b", 5.0)], "g string, x double")
    got = metrics.average_rank(rows, "x", ["g"], "r")
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted((r.g, r.x or 0.0, r.r) for r in got.collect()) == [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 3.5), ("a", 2.0, 3.5), ("b", 5.0, 1.5), ("b", 5.0, 1.5)]


def test_quotes_run_each_expression_once_and_read_odd_pages(spark, sf_dir):
    from rallyframe.plans.captures import source_quotes
    from rallyframe.sources import pages

    plan = source_quotes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StartsWith(") == len(pages.MARKETS)  # not in a filter as well
    assert plan.index("RepartitionByExpression") > plan.index('<th colspan="4">')  # texts are made above the exchange
    then = '<tr><td>01.02. 10:45</td><td class="bold">1.5</td></tr>'
    first = '<tr><td>01.01. 09:05</td><td class="bold">1.9</td></tr>'
    cell = lambda price, history="": f'<td class="k1"><div class="odds-in">{price}</div>{history}</td>'
    row = lambda *cells: '<tr class="one"><td><span class="t"> Book </span></td>' + "".join(cells) + "</tr>"
    html = [
        None, "", '<th colspan="4">Other</th>' + row(cell("1.5"), cell("2")), '<th colspan="4">Home/Away</th>' + row(cell("-"), cell("2")) + '<tr class="one">no book</tr>',
        '<th colspan="4">Home/Away</th>' + row(cell("1.5", then + "Opening odds" + first), cell("2", "Opening odds" + first + "Opening odds" + then), cell("9")),
    ]
    rows = pages.quotes(spark.createDataFrame(list(enumerate(html)), "page long, html string"), keep=["page"]).collect()
    assert sorted((r.page, r.side, r.price_close, r.closed_at, r.price_open, r.opened_at) for r in rows) == [
        (3, "p2", 2.0, None, None, None), (4, "p1", 1.5, "01.02. 10:45", 1.9, "01.01. 09:05"), (4, "p2", 2.0, None, 1.9, "01.01. 09:05"),
    ]
    assert {r.book for r in rows} == {"Book"}
