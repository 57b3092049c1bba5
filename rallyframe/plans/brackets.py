"""Queries on knockout draws: customers in the order of their numbers, fields of 16, 15 and 14 in turn, strength from account balance.

Events are played by orders: a tie of round r goes to the customer with more value in orders whose number is r - 1 modulo 4.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bracket
from .registry import query
from .views import table

ROUNDS, SIMS = 4, 50
DRAWS = """draws AS (SELECT 3 * (n // 45) + CASE WHEN n % 45 < 16 THEN 0 WHEN n % 45 < 31 THEN 1 ELSE 2 END AS draw_id, n % 45 - CASE WHEN n % 45 < 16 THEN 0 WHEN n % 45 < 31 THEN 16 ELSE 31 END AS slot,
  c_custkey AS player_id, c_acctbal AS strength FROM (SELECT *, c_custkey AS n FROM customer))"""
PADDED = f"""{DRAWS}, field AS (SELECT d.draw_id, s.slot, x.player_id, x.strength FROM (SELECT DISTINCT draw_id FROM draws) d CROSS JOIN range(0, 16) s(slot) LEFT JOIN draws x ON x.draw_id = d.draw_id AND x.slot = s.slot)"""


def chance(a, b):
    return 1 / (1 + F.exp((b - a) / 3000))


def draws(spark, d):
    """Every customer has a slot in one draw, by arithmetic on the customer's number alone: no window, no shuffle."""
    n = F.col("c_custkey")
    place = n % 45
    third = F.when(place < 16, 0).when(place < 31, 1).otherwise(2)
    first = F.when(place < 16, 0).when(place < 31, 16).otherwise(31)
    return table(spark, d, "customer").select(
        (3 * F.floor(n / 45) + third).cast("long").alias("draw_id"), (place - first).cast("int").alias("slot"), F.col("c_custkey").alias("player_id"), F.col("c_acctbal").alias("strength")
    )


@query("bracket_padding", f"WITH {PADDED} SELECT draw_id, slot, player_id FROM field")
def bracket_padding(spark, d):
    return bracket.padded(draws(spark, d), 1 << ROUNDS).select("draw_id", F.col("slot").cast("long").alias("slot"), "player_id")


def advancement_sql(field: str, name: str, rounds: int = ROUNDS, pins: str = "") -> list[str]:
    """CTEs name0 .. of the chances to win each round in a field (draw_id, slot, player_id, strength), and ``name`` with all of them; pins (draw_id, round, block, winner) are settled ties."""
    parts = [f"{name}0 AS (SELECT *, CASE WHEN player_id IS NULL THEN 0e0 ELSE 1e0 END AS p FROM {field})"]
    for r in range(1, rounds + 1):
        h, last = f"(slot // {1 << (r - 1)})", f"{name}{r - 1}"
        parts.append(
            f"""{name}{"x" if pins else ""}{r} AS (SELECT a.draw_id, a.slot, a.player_id, a.strength, a.p * (coalesce(sum(b.p / (1 + exp((b.strength - a.strength) / 3000))), 0) + 1 - coalesce(sum(b.p), 0)) AS p
FROM (SELECT *, {h} AS h FROM {last}) a LEFT JOIN (SELECT *, {h} AS h FROM {last} WHERE player_id IS NOT NULL) b ON a.draw_id = b.draw_id AND b.h = CASE WHEN a.h % 2 = 0 THEN a.h + 1 ELSE a.h - 1 END GROUP BY a.draw_id, a.slot, a.player_id, a.strength, a.p)"""
        )
        if pins:
            parts.append(f"{name}{r} AS (SELECT x.* REPLACE (CASE WHEN w.winner IS NULL THEN p WHEN w.winner = player_id THEN 1e0 ELSE 0e0 END AS p) FROM {name}x{r} x LEFT JOIN {pins} w ON w.draw_id = x.draw_id AND w.round = {r} AND w.block = slot // {1 << r})")
    chosen = ", ".join(f"{name}{r}.p AS reach_{r}" for r in range(1, rounds + 1))
    joins = " ".join(f"JOIN {name}{r} USING (draw_id, slot)" for r in range(2, rounds + 1))
    return [*parts, f"{name} AS (SELECT draw_id, slot, {name}1.player_id, {chosen} FROM {name}1 {joins} WHERE {name}1.player_id IS NOT NULL)"]


def reaches(decimals: int = 6) -> str:
    return ", ".join(f"round(reach_{r}, {decimals}) AS reach_{r}" for r in range(1, ROUNDS + 1))


def played_sql() -> list[str]:
    """CTEs ``field`` of the padded draws, ``entrants`` of their players and ``results`` of the ties that have a player (draw_id, round, block, winner, loser; no loser where it was a bye)."""
    parts = [
        PADDED, "full_ids AS (SELECT draw_id, count(*) AS size FROM draws GROUP BY draw_id)", "entrants AS (SELECT * FROM draws)",
        "score AS (SELECT o_custkey AS player_id, o_orderkey % 4 + 1 AS round, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders GROUP BY ALL)", "s0 AS (SELECT draw_id, slot AS block, player_id AS winner FROM field)",
    ]
    for r in range(1, ROUNDS + 1):
        parts.append(
            f"""p{r} AS (SELECT a.draw_id, a.block // 2 AS block, a.winner AS x, b.winner AS y, coalesce(u.v, 0) AS vx, coalesce(w.v, 0) AS vy FROM s{r - 1} a JOIN s{r - 1} b ON a.draw_id = b.draw_id AND b.block = a.block + 1
  LEFT JOIN score u ON u.player_id = a.winner AND u.round = {r} LEFT JOIN score w ON w.player_id = b.winner AND w.round = {r} WHERE a.block % 2 = 0),
s{r} AS (SELECT draw_id, block, CASE WHEN y IS NULL OR x IS NOT NULL AND vx >= vy THEN x ELSE y END AS winner, CASE WHEN y IS NULL OR x IS NOT NULL AND vx >= vy THEN y ELSE x END AS loser FROM p{r})"""
        )
    union = " UNION ALL ".join(f"SELECT draw_id, {r} AS round, block, winner, loser FROM s{r} WHERE winner IS NOT NULL" for r in range(1, ROUNDS + 1))
    return [*parts, f"results AS ({union})"]


def event_sql(select: str, *parts: str) -> str:
    return f"WITH {', '.join([*played_sql(), *parts])} {select}"


WON = "won AS (SELECT draw_id, player_id, max(w) AS rounds_won FROM (SELECT draw_id, winner AS player_id, round AS w FROM results UNION ALL SELECT draw_id, loser, round - 1 FROM results WHERE loser IS NOT NULL) GROUP BY draw_id, player_id)"


@query("bracket_advancement", f"WITH {', '.join([PADDED, *advancement_sql('field', 'r')])} SELECT draw_id, slot, player_id, {reaches()} FROM r")
def bracket_advancement(spark, d):
    field = bracket.padded(draws(spark, d), 1 << ROUNDS)
    out = bracket.advancement(field, chance, ROUNDS).filter("player_id is not null")
    return out.select("draw_id", F.col("slot").cast("long").alias("slot"), "player_id", *[F.round(f"reach_{r}", 6).alias(f"reach_{r}") for r in range(1, ROUNDS + 1)])


def simulated_sql() -> str:
    u = "CAST('0x' || substr(md5(concat_ws('|', '11', CAST(draw_id AS VARCHAR), CAST(sim AS VARCHAR), '{r}', CAST(block AS VARCHAR))), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496"
    parts = [PADDED, f"s0 AS (SELECT draw_id, sim, slot AS block, player_id AS winner, strength FROM field CROSS JOIN range(1, {SIMS + 1}) t(sim))"]
    for r in range(1, ROUNDS + 1):
        parts.append(
            f"""p{r} AS (SELECT a.draw_id, a.sim, a.block // 2 AS block, a.winner AS aw, a.strength AS sa, b.winner AS bw, b.strength AS sb FROM s{r - 1} a JOIN s{r - 1} b ON a.draw_id = b.draw_id AND a.sim = b.sim AND b.block = a.block + 1 WHERE a.block % 2 = 0),
f{r} AS (SELECT *, CASE WHEN aw IS NULL THEN false WHEN bw IS NULL THEN true ELSE {u.format(r=r)} < 1 / (1 + exp((sb - sa) / 3000)) END AS first FROM p{r}),
s{r} AS (SELECT draw_id, sim, block, CASE WHEN first THEN aw ELSE bw END AS winner, CASE WHEN first THEN sa ELSE sb END AS strength FROM f{r})"""
        )
    union = " UNION ALL ".join(f"SELECT draw_id, winner AS player_id, {r} AS round FROM s{r}" for r in range(1, ROUNDS + 1))
    return f"WITH {', '.join(parts)} SELECT draw_id, player_id, CAST(round AS BIGINT) AS round, round(count(*) / {SIMS}, 6) AS share FROM ({union}) WHERE player_id IS NOT NULL GROUP BY ALL"


@query("bracket_simulation", simulated_sql())
def bracket_simulation(spark, d):
    results = bracket.simulate(bracket.padded(draws(spark, d), 1 << ROUNDS), chance, ROUNDS, SIMS)
    return bracket.frequencies(results, SIMS).select("draw_id", "player_id", F.col("round").cast("long").alias("round"), F.round("share", 6).alias("share"))


def one_event(spark, d):
    """The players of all draws, and the draws' results; byes are passed."""
    rows = draws(spark, d)
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("player_id"), (F.col("o_orderkey") % 4).alias("m"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    values = orders.groupBy("player_id").agg(F.array(*[F.sum(F.when(F.col("m") == r, F.col("v"))) for r in range(ROUNDS)]).alias("values"))
    value = lambda side, r: F.coalesce(side["values"][r - 1], F.lit(0))
    return rows, bracket.played(bracket.padded(rows, 1 << ROUNDS).join(values, "player_id", "left"), "values", lambda r, a, b: value(a, r) >= value(b, r), ROUNDS)


@query("bracket_reconstruction", event_sql("SELECT draw_id, min(player_id) AS lo, max(player_id) AS hi, true AS meets FROM entrants GROUP BY draw_id, slot // 2"))
def bracket_reconstruction(spark, d):
    """Draws rebuilt from who beat whom; ``meets`` says that first-round opponents are those of the sheet."""
    full, results = one_event(spark, d)
    rebuilt = bracket.reconstructed(results, ROUNDS)
    tie = lambda rows, name: rows.groupBy("draw_id", F.floor(F.col("slot") / 2).alias("t")).agg(F.min("player_id").alias("lo"), F.max("player_id").alias(name)).drop("t")
    return tie(rebuilt, "hi").join(tie(full, "expected"), ["draw_id", "lo"]).select("draw_id", "lo", "hi", (F.col("hi") == F.col("expected")).alias("meets"))


@query("bracket_progression", event_sql(f"SELECT draw_id, player_id, CAST(coalesce(rounds_won, 0) AS BIGINT) AS rounds_won, {reaches()} FROM r LEFT JOIN won USING (draw_id, player_id)", *advancement_sql("entrants", "r"), WON))
def bracket_progression(spark, d):
    """How far each player came against the chances before the event: a pre-event and actual table; a player without a result has won no round."""
    full, results = one_event(spark, d)
    table_ = bracket.advancement(full, chance, ROUNDS).join(bracket.progression(results), ["draw_id", "player_id"], "left")
    return table_.select("draw_id", "player_id", F.coalesce("rounds_won", F.lit(0)).alias("rounds_won"), *[F.round(f"reach_{r}", 6).alias(f"reach_{r}") for r in range(1, ROUNDS + 1)])


@query(
    "bracket_stages",
    event_sql(
        "SELECT draw_id, player_id, CAST(rounds_won AS BIGINT) AS rounds_won, STAGE AS reached, CASE WHEN rounds_won < 4 THEN STAGE END AS lost_in FROM won".replace("STAGE", "CASE rounds_won WHEN 0 THEN 'R16' WHEN 1 THEN 'QF' WHEN 2 THEN 'SF' WHEN 3 THEN 'F' ELSE 'W' END"), WON
    ),
)
def bracket_stages(spark, d):
    """The stage that each player reached, and the round that ended the run."""
    return bracket.stages(bracket.progression(one_event(spark, d)[1]), 1 << ROUNDS)


@query(
    "bracket_surprises",
    event_sql(
        "SELECT draw_id, player_id, CAST(rounds_won AS BIGINT) AS rounds_won, chance FROM c WHERE chance < 0.1 ORDER BY chance, draw_id, player_id LIMIT 10", *advancement_sql("entrants", "r"), WON,
        "c AS (SELECT draw_id, player_id, rounds_won, round([reach_1, reach_2, reach_3, reach_4][rounds_won], 6) AS chance FROM r JOIN won USING (draw_id, player_id) WHERE rounds_won > 0)",
    ),
)
def bracket_surprises(spark, d):
    """Rounds won against chances under ten percent, the least likely first; ten of them."""
    full, results = one_event(spark, d)
    rows = bracket.advancement(full, chance, ROUNDS).join(bracket.progression(results), ["draw_id", "player_id"])
    p = F.array(*[F.col(f"reach_{r}") for r in range(1, ROUNDS + 1)])
    won = rows.select("draw_id", "player_id", "rounds_won", F.round(F.get(p, (F.col("rounds_won") - 1).cast("int")), 6).alias("chance")).filter("rounds_won > 0 and chance < 0.1")
    return won.orderBy("chance", "draw_id", "player_id").limit(10)


@query(
    "bracket_calls",
    event_sql(
        """SELECT CAST(round AS BIGINT) AS round, CASE WHEN p >= 0.5 THEN 'ok' WHEN p >= 0.4 THEN 'near' WHEN p >= 0.25 THEN 'miss' ELSE 'upset' END AS call, count(*) AS n, round(avg(p), 6) AS share FROM (
  SELECT round, 1 / (1 + exp((l.strength - w.strength) / 3000)) AS p FROM results JOIN entrants w ON w.draw_id = results.draw_id AND w.player_id = winner JOIN entrants l ON l.draw_id = results.draw_id AND l.player_id = loser) GROUP BY ALL"""
    ),
)
def bracket_calls(spark, d):
    """Played ties graded by the share that their winner was given."""
    full, results = one_event(spark, d)
    s = full.select("draw_id", "player_id", "strength")
    rows = results.join(s.select("draw_id", F.col("player_id").alias("winner"), F.col("strength").alias("ws")), ["draw_id", "winner"]).join(s.select("draw_id", F.col("player_id").alias("loser"), F.col("strength").alias("ls")), ["draw_id", "loser"])
    p = chance(F.col("ws"), F.col("ls"))
    return rows.groupBy(F.col("round").cast("long").alias("round"), bracket.graded(p).alias("call")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("share"))


@query(
    "bracket_live_move",
    event_sql(
        "SELECT draw_id, player_id, n.reach_3 IS NOT NULL AS alive, round(r.reach_4, 6) AS before, round(coalesce(n.reach_3, 0), 6) AS now, round(coalesce(n.reach_3, 0) - r.reach_4, 6) AS move FROM r LEFT JOIN n USING (draw_id, player_id)",
        *advancement_sql("entrants", "r"), "left_in AS (SELECT s1.draw_id, s1.block AS slot, player_id, strength FROM s1 JOIN entrants ON entrants.draw_id = s1.draw_id AND player_id = winner)", *advancement_sql("left_in", "n", ROUNDS - 1),
    ),
)
def bracket_live_move(spark, d):
    """Title chances of every player after the first round against those before; losers are out."""
    full, results = one_event(spark, d)
    before = bracket.advancement(full, chance, ROUNDS).select("draw_id", "player_id", F.col(f"reach_{ROUNDS}").alias("before"))
    winners = results.filter("round = 1").select("draw_id", F.col("block").alias("slot"), F.col("winner").alias("player_id"))
    field = winners.join(full.select("draw_id", "player_id", "strength"), ["draw_id", "player_id"])
    after = bracket.advancement(field, chance, ROUNDS - 1).select("draw_id", "player_id", F.col(f"reach_{ROUNDS - 1}").alias("now"))
    out = before.join(after, ["draw_id", "player_id"], "left").withColumn("alive", F.col("now").isNotNull()).withColumn("now", F.coalesce("now", F.lit(0.0)))
    return out.select("draw_id", "player_id", "alive", F.round("before", 6).alias("before"), F.round("now", 6).alias("now"), F.round(F.col("now") - F.col("before"), 6).alias("move"))


@query(
    "bracket_pinned",
    event_sql(f"SELECT draw_id, player_id, {reaches()} FROM r", "pins AS (SELECT * FROM results WHERE round = 1 OR round = 2 AND (draw_id + block) % 3 <> 0)", *advancement_sql("entrants", "r", pins="pins")),
)
def bracket_pinned(spark, d):
    """Chances in a running event: played ties of two rounds are pinned, ties still on court and later ones are open."""
    full, results = one_event(spark, d)
    pins = results.filter((F.col("round") == 1) | ((F.col("round") == 2) & ((F.col("draw_id") + F.col("block")) % 3 != 0)))
    return bracket.advancement(full, chance, ROUNDS, pins).select("draw_id", "player_id", *[F.round(f"reach_{r}", 6).alias(f"reach_{r}") for r in range(1, ROUNDS + 1)])


@query("bracket_replayable", event_sql("SELECT draw_id, count(*) AS draw_size, min(player_id) AS first_player FROM entrants WHERE draw_id % 5 <> 0 GROUP BY draw_id"))
def bracket_replayable(spark, d):
    """Events whose draw can be rebuilt from their results; every fifth has lost its final and cannot."""
    _, results = one_event(spark, d)
    known = results.filter((F.col("draw_id") % 5 != 0) | (F.col("round") < ROUNDS))
    return bracket.reconstructed(known, ROUNDS).groupBy("draw_id").agg(F.count("*").alias("draw_size"), F.min("player_id").alias("first_player"))


@query(
    "bracket_state",
    event_sql(
        """SELECT t.draw_id, CAST(t.round AS BIGINT) AS round, t.block, x, y, CASE WHEN t.round = 2 AND (t.draw_id + t.block) % 3 = 0 THEN 'live' ELSE 'played' END AS state,
  CASE WHEN t.round = 1 OR (t.round = 2 AND (t.draw_id + t.block) % 3 <> 0) THEN winner END AS winner, round(1 / (1 + exp((CASE WHEN winner = x THEN ly.strength - lx.strength ELSE lx.strength - ly.strength END) / 3000)), 6) AS winner_prob
FROM t JOIN entrants lx ON lx.player_id = x JOIN entrants ly ON ly.player_id = y""",
        "t AS (SELECT draw_id, 1 AS round, block, x, y, CASE WHEN vx >= vy THEN x ELSE y END AS winner FROM p1 UNION ALL SELECT draw_id, 2, block, x, y, CASE WHEN vx >= vy THEN x ELSE y END FROM p2)",
    ),
)
def bracket_state(spark, d):
    """Ties of which both sides are known after two rounds of a running event: played ones with their winner, live ones without; and the chance that the actual winner had."""
    full, results = one_event(spark, d)
    live = (F.col("round") == 2) & ((F.col("draw_id") + F.col("block")) % 3 == 0)
    known = results.filter("round <= 2").select("draw_id", "round", "block", F.when(live, "live").otherwise("played").alias("state"), "winner", "loser")
    s = full.select("draw_id", "player_id", "strength", "slot")
    side = lambda c, a, z: s.select("draw_id", F.col("player_id").alias(c), F.col("strength").alias(a), F.col("slot").alias(z))
    met = known.join(side("winner", "ws", "wz"), ["draw_id", "winner"]).join(side("loser", "ls", "lz"), ["draw_id", "loser"])
    upper = F.col("wz") < F.col("lz")
    return met.select(
        "draw_id", F.col("round").cast("long").alias("round"), F.col("block").cast("long").alias("block"), F.when(upper, F.col("winner")).otherwise(F.col("loser")).alias("x"), F.when(upper, F.col("loser")).otherwise(F.col("winner")).alias("y"),
        "state", F.when(F.col("state") == "played", F.col("winner")).alias("winner"), F.round(chance(F.col("ws"), F.col("ls")), 6).alias("winner_prob"),
    )


@query(
    "bracket_withdrawals",
    f"WITH {DRAWS} SELECT draw_id, slot, CASE WHEN slot = 3 THEN -player_id ELSE player_id END AS player_id, slot = 3 AS replaced FROM draws",
)
def bracket_withdrawals(spark, d):
    """Sheets whose slot 3 withdrew, an alternate having played from the same tie."""
    sheet = draws(spark, d).select("draw_id", "slot", "player_id")
    away = F.col("slot") == 3
    entrants = sheet.select("draw_id", F.when(away, -F.col("player_id")).otherwise(F.col("player_id")).alias("player_id"), F.floor(F.col("slot") / 2).alias("tie"))
    return bracket.reconciled(sheet, entrants).withColumn("slot", F.col("slot").cast("long"))
