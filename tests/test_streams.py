"""Streams over several batches: late, early and unmatched rows, restarts, and what a full build gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row

from rallyframe.streaming import captures, frame, ledger


def plain_frame(rows):
    """FRAME by going through each player's results in order."""
    out, history = {}, {}
    for r in sorted(rows, key=lambda r: (r["day"], r["match_id"])):
        past = history.setdefault(r["player_id"], [])
        mean = lambda xs: sum(xs) / len(xs) if xs else None
        values = [len(past)]
        for n in frame.WINDOWS:
            values += [mean([p["won"] for p in past[-n:]]), mean([p["margin"] for p in past[-n:] if p["margin"] is not None])]
        own = [p["won"] for p in past if p["surface"] == r["surface"]]
        values += [mean([p["won"] for p in past]), len(own), mean(own)]
        for h in frame.HALF_LIVES:
            w = [0.5 ** ((len(past) - 1 - i) / h) for i in range(len(past))]
            values.append(sum(a * p["won"] for a, p in zip(w, past, strict=True)) / sum(w) if past else None)
        streak = 0
        while streak < len(past) and past[-1 - streak]["surface"] == r["surface"]:
            streak += 1
        met = [p["won"] for p in past if p["opponent_id"] == r["opponent_id"]]
        values += [r["day"] - past[-1]["day"] if past else None, sum(r["day"] - frame.LOAD_DAYS <= p["day"] for p in past[-frame.RECENT :]), streak, sum(met), len(met) - sum(met), False]
        out[r["match_id"], r["player_id"]] = values
        if not r["walkover"]:
            past.append(r)
    return out


def results(n=700, players=12):
    random.seed(4)
    rows = []
    for m in range(n):
        a, b = random.sample(range(players), 2)
        margin, day, surface, out = random.choice([None, 5, 70, 1234]), m // 6, random.choice("abc"), m % 41 == 3
        rows += [{"match_id": m, "player_id": x, "opponent_id": y, "day": day, "surface": surface, "won": w, "margin": margin, "walkover": out} for x, y, w in ((a, b, 1), (b, a, 0))]
    return rows


def by_key(rows):
    return {(r.match_id, r.player_id): [round(x, 9) if isinstance(x, float) else x for x in r[2:]] for r in rows}


def test_batches_equal_the_full_frame(spark, tmp_path):
    rows = results()
    docs = spark.createDataFrame(rows, frame.RESULT)
    got = by_key(frame.in_batches(docs, f"file://{tmp_path}/three", [150, 500]).collect())
    assert got == {k: [round(x, 9) if isinstance(x, float) else x for x in v] for k, v in plain_frame(rows).items()}
    assert max(v[0] for v in got.values()) > frame.RECENT and frame.built(docs.limit(0), f"file://{tmp_path}/three").count() == len(rows)


def test_a_late_result_is_marked(spark, tmp_path):
    rows = [r for r in results(40, 4)]
    late = [r for r in rows if r["match_id"] == 5]
    frame.built(spark.createDataFrame([r for r in rows if r["match_id"] != 5], frame.RESULT), f"file://{tmp_path}/x")
    got = frame.built(spark.createDataFrame(late, frame.RESULT), f"file://{tmp_path}/x").filter("match_id = 5").collect()
    assert len(got) == 2 and all(r.late for r in got)


def test_a_batch_reads_and_writes_a_players_state_once():
    """However many opponents there are; sums of windows that go on from it equal those of the rows."""
    calls, kept = [], {}

    class State:
        def get(self):
            calls.append("get")
            return kept.get("form")

        def update(self, value):
            calls.append("update")
            kept["form"] = value

    rows = [r for r in results(700, 30) if r["player_id"] == 3]
    assert len(rows) > frame.RECENT // 2
    form = frame.PlayerForm()
    form.init(type("Handle", (), {"getValueState": lambda *_: State()})())
    got = [x for part in (rows[:30], rows[30:]) for x in form.handleInputRows((3,), [Row(**r) for r in part], None)]
    assert calls == ["get", "update"] * 2
    assert by_key(got) == {k: [round(x, 9) if isinstance(x, float) else x for x in v] for k, v in plain_frame(rows).items()}


T0 = datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    day = lambda n: T0 + timedelta(days=n)

    def run(batches):
        folder = f"file://{tmp_path}/feed"
        for played, seen in batches:
            captures.run_batch(
                spark, folder, spark.createDataFrame([(m, day(t)) for m, t in played], captures.RESULTS), spark.createDataFrame([(m, day(t), p, 2.0, str(p)) for m, t, p in seen], captures.CAPTURES)
            )
        captures.close(spark, folder)
        rows = captures.captured(spark, folder).collect()
        return {r.match_id: (r.p1_price, r.n_before, r.n_after) for r in rows}, spark.read.parquet(f"{folder}/out").filter("match_id >= 0").count()

    return run


def test_captures_before_at_and_after_play(feed):
    batches = [
        ([(1, 5), (2, 6)], [(1, 1, 1.1), (1, 4, 1.4), (2, 0, 2.0), (9, 3, 9.0)]),  # 9 is never played
        ([(3, 12)], [(1, 5, 1.5), (1, 7, 1.7), (3, 11, 3.1)]),  # at the time of play counts as before; after it does not
        ([(4, 20)], [(4, 12, 4.2), (4, 13, 4.3), (4, 19, 4.9)]),  # eight days are too many
        ([(5, 30), (6, 31)], [(6, 37, 6.7)]),  # no capture; one after play alone
        ([(7, 41)], [(7, 48, 7.8), (5, 5, 5.5)]),  # a capture that comes weeks late is left out by the watermark
    ]
    got, n = feed(batches)
    assert got == {1: (1.5, 3, 1), 2: (2.0, 1, 0), 3: (3.1, 1, 0), 4: (4.9, 2, 0), 5: (None, 0, 0), 6: (None, 0, 1), 7: (None, 0, 1)}
    assert n == 4 + 1 + 1 + 2 + 1 + 1 + 1


def test_captures_of_odd_matches(spark, tmp_path):
    """Matches below zero, without a number, without a time of play and of early years are matches too."""
    folder, day = f"file://{tmp_path}/odd", lambda n: None if n is None else T0 + timedelta(days=n)
    played = [(-5, day(5)), (-2, day(6)), (None, day(7)), (8, None), (9, day(-40_000))]
    seen = [(m, day(t), p, 2.0, str(p)) for m, t, p in ((-5, 4, 1.4), (None, 7, 7.0), (8, None, 8.0), (9, -40_001, 9.1), (-5, None, 5.0))]
    captures.run_batch(spark, folder, spark.createDataFrame(played, captures.RESULTS), spark.createDataFrame(seen, captures.CAPTURES))
    captures.close(spark, folder)
    got = {r.match_id: (r.p1_price, r.n_before, r.n_after) for r in captures.captured(spark, folder).collect()}
    assert got == {-5: (1.4, 1, 0), -2: (None, 0, 0), None: (None, 0, 0), 8: (None, 0, 0), 9: (9.1, 1, 0)}


def test_wide_batches_keep_a_band_and_equal_one_join(spark, tmp_path):
    """A batch of a year leaves some days of rows behind, in no state store; a batch that is written again changes nothing; pairs of all batches are those of one join."""
    random.seed(7)
    folder, at = f"file://{tmp_path}/wide", lambda n: T0 + timedelta(hours=n)
    played = [(m, random.randrange(900 * 24)) for m in range(400)]
    seen = [(m, t + random.choice([-169, -168, -1, 0, 1, 168, 169, random.randrange(-400, 400)]), m + i / 8, str(i)) for m, t in played for i in range(random.randrange(5))]
    r = [(m, at(t)) for m, t in played]
    c = [(m, at(t), p, 2.0, s) for m, t, p, s in seen]
    cuts = [None, at(365 * 24), at(620 * 24), None]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = lambda rows: [x for x in rows if (a is None or x[1] >= a) and (b is None or x[1] < b)]  # noqa: B023, E731
        captures.run_batch(spark, folder, spark.createDataFrame(part(r), captures.RESULTS), spark.createDataFrame(part(c), captures.CAPTURES))
        kept = spark.read.parquet(f"{folder}/kept/batch={i}").collect()
        mark = min(max(x[1] for x in part(rows)) for rows in (r, c)) - timedelta(days=2)
        assert {(x.match_id, x.at) for x in kept} == {x[:2] for rows, reach in ((part(r), 7), (part(c), 15)) for x in rows if x[1] + timedelta(days=reach) >= mark}
    out = lambda: sorted(map(tuple, spark.read.parquet(f"{folder}/out/batch=2").collect()), key=str)
    first = out()
    batch = lambda rows, played: [(x[0], x[1], *(x[2:] or (None, None, None)), played) for x in part(rows)]
    captures.step(spark.createDataFrame(batch(r, True) + batch(c, False), captures.ROWS), 2, folder)
    assert out() == first and not (tmp_path / "wide" / "checkpoint" / "state").exists() and sorted(x.name for x in (tmp_path / "wide" / "kept").iterdir()) == ["batch=1", "batch=2"]
    captures.close(spark, folder)
    whole = captures.promoted(captures.met(spark.createDataFrame(r, captures.RESULTS), spark.createDataFrame(c, captures.CAPTURES)))
    assert sorted(map(tuple, captures.captured(spark, folder).collect())) == sorted(map(tuple, whole.collect())) and whole.count() == len(r)



def test_days_of_spans():
    d = lambda n: (datetime(2024, 1, 1) + timedelta(n)).date()
    done = [(d(3), d(4)), (d(8), d(8))]
    assert list(ledger.days_down(d(0), d(10), done)) == [d(i) for i in (10, 9, 7, 6, 5, 2, 1, 0)]
    assert list(ledger.days_down(d(3), d(4), done)) == [] and list(ledger.days_down(d(5), d(4), [])) == []
    assert ledger.spans_of(ledger.text_of([(d(1), d(2)), (d(3), d(3)), (d(6), d(7))])) == [(d(6), d(7)), (d(1), d(3))]
    assert ledger.text_of([]) == "" and ledger.spans_of("") == []


@pytest.mark.parametrize("lost_at", ["before", "after"])
def test_backfill_goes_on_after_a_loss(spark, tmp_path, lost_at):
    d = lambda n: (datetime(2024, 1, 1) + timedelta(n)).date()
    html = lambda n: None if n == 9 else "" if n == 5 else f"m{n},m{n}b" if n != 2 else "m2,m7"
    site = {d(n): html(n) for n in range(12) if n != 6}  # m7 is also on a page of an earlier day, day 6 has no page
    read: list = []

    def pages(days, broken=False):
        read.append(list(days))
        if broken and len(read) == 3 and lost_at == "before":
            raise RuntimeError("lost")
        return spark.createDataFrame([(x, 1, site[x]) for x in days if x in site], "day date, page bigint, html string")

    def parse(rows, broken=False):
        out = rows.selectExpr("explode(split(html, ',')) match_id", "day", "page").filter("match_id <> ''")
        if broken and len(read) == 3 and lost_at == "after":
            out.write.parquet(f"{tmp_path}/b/rows/batch=2")  # the rows are there, the ledger is not
            raise RuntimeError("lost")
        return out

    def state(folder):
        rows = ledger.matches(spark, folder, "match_id string, day date, page bigint").collect()
        return {r.match_id: r.day for r in rows}, {r.day: (r.status, r.n) for r in ledger.ledger(spark, folder).collect()}, rows

    ledger.backfill(spark, f"{tmp_path}/a", d(0), d(11), pages, parse, 3)
    read.clear()
    with pytest.raises(Exception, match="lost"):
        ledger.backfill(spark, f"{tmp_path}/b", d(0), d(11), lambda x: pages(x, True), lambda x: parse(x, True), 3)
    assert len(state(f"{tmp_path}/b")[1]) == 6
    read.clear()
    ledger.backfill(spark, f"{tmp_path}/b", d(0), d(11), pages, parse, 3)
    # days that failed come again, those that are done do not
    assert read == [[d(9), d(6)], [d(5), d(4), d(3)], [d(2), d(1), d(0)]]
    assert state(f"{tmp_path}/a")[:2] == state(f"{tmp_path}/b")[:2]
    found, known, rows = state(f"{tmp_path}/b")
    assert len(found) == len(rows) and found["m7"] == d(7) and len(known) == 12
    assert {x: s for x, (s, _) in known.items() if s != "ok"} == {d(9): "error", d(6): "error", d(5): "empty"}
    # the broken page is mended, and there are new days
    site[d(9)], site[d(12)], site[d(6)] = "m9", "m12", ""
    read.clear()
    ledger.backfill(spark, f"{tmp_path}/b", d(0), d(13), pages, parse, 3)
    assert read == [[d(9), d(6)], [d(13), d(12)]]
    found, known, rows = state(f"{tmp_path}/b")
    assert found["m9"] == d(9) and found["m12"] == d(12) and known[d(9)] == ("ok", 1) and known[d(6)] == ("empty", 0) and known[d(13)] == ("error", 0)
