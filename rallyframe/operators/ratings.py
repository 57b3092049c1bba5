"""Sequential ratings: a fold over each pool's results in order, pools in parallel, resumable from its state.

A rating depends on all earlier results of a pool, so a pool's fold is sequential; pools (tours, circuits,
or pool x parameter set in a sweep) are independent and spread over the cluster. Rows of a pool stream through a task in
sorted order, are emitted before they are folded in, and are not held: memory is the players' state. The state leaves as rows too, and
rows of an earlier state come before a pool's results, so a fold of new results alone goes on where the last one ended.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import streamed


@dataclass(frozen=True)
class EloRule:
    """Fixed values of the rating rule; k falls with matches played, idle players drift to the base."""

    base: float = 1500.0
    k_scale: float = 200.0
    k_offset: float = 5.0
    k_power: float = 0.4
    idle_rate: float = 0.25
    idle_grace: int = 90
    blend: float = 60.0
    margin_weight: bool = False
    season_regress: float = 0.0  # share of the way back to the base at each change of season


def expected(a: Column, b: Column) -> Column:
    """Chance of the first of two ratings."""
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def k_factor(n: Column, rule: EloRule = EloRule()) -> Column:  # noqa: B008
    return rule.k_scale / F.pow(n + rule.k_offset, F.lit(rule.k_power))


def drifted(rating: Column, idle_days: Column, rule: EloRule = EloRule()) -> Column:  # noqa: B008
    """A rating after days without a match."""
    years = (idle_days - rule.idle_grace) / 365.0
    return F.when(years > 0, rule.base + (rating - rule.base) * F.pow(F.lit(1.0 - rule.idle_rate), years)).otherwise(rating)


MATCH = "match_id bigint, w_elo double, l_elo double, w_surface_elo double, l_surface_elo double"
STATE = "player_id bigint, scope string, rating double, played bigint, last_day int, season bigint"
RESULT = ("match_id", "day", "surface", "winner_id", "loser_id", "margin", "walkover")
NO_STATE = [None] * len(STATE.split(", "))
ANSWER = "ask_id bigint, player_id bigint, elo double, surface_elo double, played bigint"


def _fields(ddl: str) -> list[T.StructField]:
    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "int": T.IntegerType()}
    return [T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))]


class _Scope:
    """Ratings of all results (None) or of a surface: flat arrays by a player's number. A rating knows at which change of season it was written, -1 where a player has none."""

    def __init__(self):
        self.rating, self.played, self.written = array("d"), array("q"), array("q")

    def reach(self, i: int) -> None:
        """Makes room for number i, and for as many again."""
        if i >= len(self.rating):
            more = i + 1
            self.rating.extend(repeat(0.0, more))
            self.played.extend(repeat(0, more))
            self.written.extend(repeat(-1, more))

    def has(self, i: int | None) -> bool:
        return i is not None and i < len(self.written) and self.written[i] >= 0


class _Pool:
    """Ratings of a pool. A change of season moves all ratings, but only its number is kept: each rating knows at which change it was last written and is moved when it is read.

    Players are numbered as they come and their state lies in arrays, about 24 bytes a player and scope, and a dictionary entry a player.
    """

    NEVER = -(1 << 62)

    def __init__(self, rule: EloRule, rated: bool = True, state: bool = True):
        self.rule, self.rated, self.state = rule, rated, state
        self.number: dict = {}
        self.last = array("q")
        self.scopes: dict[str | None, _Scope] = {None: _Scope()}
        self.season, self.changes = None, 0

    def index(self, player) -> int:
        i = self.number.get(player)
        if i is None:
            i = self.number[player] = len(self.last)
            self.last.append(self.NEVER)
        return i

    def scope(self, surface) -> _Scope:
        found = self.scopes.get(surface)
        if found is None:
            found = self.scopes[surface] = _Scope()
        return found

    def value(self, i: int | None, scope: _Scope, day, seed: float) -> float:
        """The stored rating, or seed, with the drift that idle days owe."""
        r = seed
        if scope.has(i):
            r = scope.rating[i]
            if behind := self.changes - scope.written[i]:
                r = self.rule.base + (r - self.rule.base) * (1.0 - self.rule.season_regress) ** behind
        if day is not None and i is not None and self.last[i] != self.NEVER:
            years = (day - self.last[i] - self.rule.idle_grace) / 365.0
            if years > 0:
                r = self.rule.base + (r - self.rule.base) * (1.0 - self.rule.idle_rate) ** years
        return r

    def seen(self, player, surface, day) -> tuple[float, float]:
        """Overall rating, and surface rating blended by matches on the surface."""
        i, own = self.number.get(player), self.scope(surface)
        overall, n = self.value(i, self.scopes[None], day, self.rule.base), own.played[i] if own.has(i) else 0
        return overall, (n * self.value(i, own, day, overall) + self.rule.blend * overall) / (n + self.rule.blend)

    def fold(self, winner, loser, surface, day, margin: float) -> None:
        rule, factor = self.rule, 1.0
        if rule.margin_weight:
            factor = min(1.8, max(0.5, math.log1p(max(0.0, margin)) / math.log1p(5)))
        sides, overall = (self.index(winner), self.index(loser)), self.scopes[None]
        for scope in (overall, self.scope(surface)):  # a new surface rating starts from the overall one just updated
            a, b = (self.value(i, scope, day, self.value(i, overall, day, rule.base)) for i in sides)
            surprise = 1 - 1 / (1 + 10 ** ((b - a) / 400))
            scope.reach(max(sides))
            for i, r, sign in ((sides[0], a, 1), (sides[1], b, -1)):
                n = scope.played[i]
                scope.rating[i] = r + sign * factor * rule.k_scale / (n + rule.k_offset) ** rule.k_power * surprise
                scope.played[i], scope.written[i] = n + 1, self.changes
        if day is not None:
            self.last[sides[0]] = self.last[sides[1]] = day

    def begin(self, season) -> None:
        """Counts a change of season before the season's first result."""
        if self.rule.season_regress and season is not None:
            self.changes += self.season is not None and season != self.season
            self.season = season

    def row(self, row: dict) -> Iterator[tuple]:
        if row["_known"]:
            i, scope = self.index(row["player_id"]), self.scope(row["scope"])
            scope.reach(i)
            scope.rating[i], scope.played[i], scope.written[i], self.season = row["rating"], row["played"], 0, row["season"]
            if row["last_day"] is not None:
                self.last[i] = row["last_day"]
            return
        m, day, surface, w, x, margin, walkover = (row[c] for c in RESULT)
        self.begin(row["_season"])
        if self.rated:
            (wo, ws), (lo, ls) = self.seen(w, surface, day), self.seen(x, surface, day)
            yield (m, wo, lo, ws, ls, *NO_STATE)
        if not walkover:
            self.fold(w, x, surface, day, margin)

    def end(self) -> Iterator[tuple]:
        if not self.state:
            return
        for name, scope in self.scopes.items():
            for player, i in self.number.items():
                if scope.has(i):
                    last = self.last[i]
                    yield (*[None] * 5, player, name, self.value(i, scope, None, self.rule.base), scope.played[i], None if last == self.NEVER else last, self.season)


class _AskedPool(_Pool):
    """A pool that answers questions about players on the way and says nothing else."""

    def __init__(self, rule: EloRule):
        super().__init__(rule, rated=False, state=False)

    def row(self, row: dict) -> Iterator[tuple]:
        if row["ask_id"] is None:
            yield from super().row(row)
        else:
            self.begin(row["_season"])
            player, overall = row["player_id"], self.scopes[None]
            i = self.number.get(player)
            yield (row["ask_id"], player, *self.seen(player, row["surface"], row["day"]), overall.played[i] if overall.has(i) else 0)


def elo_fold(results: DataFrame, pool: list[str], rules: EloRule | dict[str, EloRule] = EloRule(), state: DataFrame | None = None, says: tuple[bool, bool] = (True, True)) -> DataFrame:  # noqa: B008
    """pool, and either the columns MATCH of each result or, after them, the columns STATE of each player and scope.

    results: pool, match_id (the order), day (a number of days, or null), surface, winner_id, loser_id, margin, walkover, and season where a rule regresses at its changes.
    Walkovers are emitted but not folded in. Several rules are named by the pool's last column. state: pool and STATE of earlier results.
    says: whether rows of matches and of players leave the fold.
    """
    start = (lambda key: _Pool(rules[key[-1]], *says)) if isinstance(rules, dict) else (lambda key: _Pool(rules, *says))
    rows = results.select(*pool, *RESULT, _season(results)).withColumn("_known", F.lit(False))
    known = _fields(STATE)
    if state is None:
        rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in known])
    else:
        rows = rows.unionByName(state.select(*pool, *[f.name for f in known]).withColumn("_known", F.lit(True)), allowMissingColumns=True)
    return streamed(rows, pool, [F.desc("_known"), "match_id"], start, T.StructType(_fields(f"{MATCH}, {STATE}")))


def _season(rows: DataFrame) -> Column:
    return (F.col("season") if "season" in rows.columns else F.lit(None)).cast("long").alias("_season")


def elo_asked(results: DataFrame, questions: DataFrame, pool: list[str], rule: EloRule = EloRule()) -> DataFrame:  # noqa: B008
    """pool and ANSWER: what players were rated at many points of the pools' histories, by one fold of each pool.

    questions: pool, ask_id, match_id, player_id, surface, day (and season): the rating of a player just before that match. They travel in the pool's stream, in front of
    the result of that number, and the fold answers with the state of the asked player alone; so any number of replays costs one reading of the results.
    """
    rows = results.select(*pool, *RESULT, _season(results)).withColumns({"ask_id": F.lit(None).cast("long"), "player_id": F.lit(None).cast("long"), "_known": F.lit(False), "_asks": F.lit(1)})
    asked = questions.select(*pool, "ask_id", "match_id", "player_id", "surface", "day", _season(questions)).withColumns({"_known": F.lit(False), "_asks": F.lit(0)})
    return streamed(rows.unionByName(asked, allowMissingColumns=True), pool, ["match_id", "_asks"], lambda _: _AskedPool(rule), T.StructType(_fields(ANSWER)))


def elo(results: DataFrame, pool: list[str], rule: EloRule = EloRule(), state: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """pool, match_id and the ratings of both players before each match."""
    return elo_fold(results, pool, rule, state, (True, False)).filter("match_id is not null").select(*pool, *[f.name for f in _fields(MATCH)])


def elo_state(results: DataFrame, pool: list[str], rule: EloRule = EloRule(), state: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """pool and STATE after the last result: a row a player for all results (null scope) and for each surface."""
    return elo_fold(results, pool, rule, state, (False, True)).filter("match_id is null").select(*pool, *[f.name for f in _fields(STATE)])


def elo_sweep(results: DataFrame, pool: list[str], rules: dict[str, EloRule]) -> DataFrame:
    """elo under several rules, named in ``rule``: pools times rules run in parallel over one reading of the results."""
    several = results.withColumn("rule", F.explode(F.array(*map(F.lit, rules))))
    return elo_fold(several, [*pool, "rule"], rules, says=(True, False)).filter("match_id is not null").select(*pool, "rule", *[f.name for f in _fields(MATCH)])


SERVE = "match_id bigint, w_serve double, w_return double, l_serve double, l_return double"
SERVED = ("match_id", "surface", "winner_id", "loser_id", "w_points", "w_won", "l_points", "l_won")


class _ServePool:
    def __init__(self, average: float, rate: float, prior: float, surface_share: float):
        self.average, self.rate, self.prior, self.surface_share = average, rate, prior, surface_share
        self.overall: dict = {}  # player: [serve, return, points served, points returned]
        self.on_surface: dict = {}  # (player, surface): [serve, return, points of both kinds]

    def seen(self, player, surface) -> tuple[float, float]:
        """Serve and return, each shrunk by its own points, blended with the surface's by all points played there."""
        serve, back, n_serve, n_back = self.overall.get(player, (0.0, 0.0, 0.0, 0.0))
        own_serve, own_back, n = self.on_surface.get((player, surface), (0.0, 0.0, 0.0))
        shrink = lambda x, points: x * points / (points + self.prior)
        w = self.surface_share * n / (n + self.prior)
        return (1 - w) * shrink(serve, n_serve) + w * shrink(own_serve, n), (1 - w) * shrink(back, n_back) + w * shrink(own_back, n)

    def row(self, row: dict) -> Iterator[tuple]:
        m, surface, w, x, *counts = (row[c] for c in SERVED)
        (ws, wr), (ls, lr) = self.seen(w, surface), self.seen(x, surface)
        yield m, ws, wr, ls, lr
        if any(v is None or not math.isfinite(v) for v in counts) or counts[0] <= 0 or counts[2] <= 0:
            return
        for server, returner, n, won, chance in ((w, x, counts[0], counts[1], self.average + ws - lr), (x, w, counts[2], counts[3], self.average + ls - wr)):
            move = self.rate * (won / n - chance) * min(n / 100.0, 1.5)
            for player, i, step in ((server, 0, move), (returner, 1, -move)):
                overall, own = self.overall.setdefault(player, [0.0] * 4), self.on_surface.setdefault((player, surface), [0.0] * 3)
                overall[i] += step
                overall[2 + i] += n
                own[i] += step
                own[2] += n

    def end(self) -> Iterator[tuple]:
        return iter(())


def serve_return(results: DataFrame, pool: list[str], average: float, rate: float = 0.04, prior: float = 400.0, surface_share: float = 0.35) -> DataFrame:
    """Serve and return ratings before each match, as deviations from the average share of points won on serve.

    results: pool, match_id, surface, winner_id, loser_id, w_points, w_won, l_points, l_won. Rows without finite, positive counts are emitted only.
    """
    return streamed(results.select(*pool, *SERVED), pool, ["match_id"], lambda key: _ServePool(average, rate, prior, surface_share), T.StructType(_fields(SERVE)))


def current(rated: DataFrame, results: DataFrame, pool: list[str]) -> DataFrame:
    """pool, player_id, rating, n: the rating with which each player entered their last match."""
    rows = results.select(*pool, "match_id", "winner_id", "loser_id").join(rated, [*pool, "match_id"])
    sides = F.explode(F.array(F.struct(F.col("winner_id").alias("player_id"), F.col("w_elo").alias("r")), F.struct(F.col("loser_id").alias("player_id"), F.col("l_elo").alias("r"))))
    long = rows.select(*pool, "match_id", sides.alias("s")).select(*pool, "match_id", "s.player_id", "s.r")
    return long.groupBy(*pool, "player_id").agg(F.max_by("r", "match_id").alias("rating"), F.count("*").alias("n"))
