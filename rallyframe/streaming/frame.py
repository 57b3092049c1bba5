"""The feature frame as a stream: results come in batches, every player's state is kept, and each row leaves with the form before it.

State of a player, by ``transformWithState``: one value with counters, exponential sums, the last day, and arrays of the last RECENT results, of surfaces
and of meetings by opponent. All but the meetings are of fixed size, and these have one entry an opponent. A value is read and written once a player and batch,
as each call of the state costs more than a result's own work. A stopped stream goes on from its checkpoint, so that a batch costs its own rows and its players' states, not the history.

Results of a player are folded by (day, match_id) within a batch. A result that comes in a later batch than one that was played after it is
emitted and folded as it comes, and marked ``late``: it would take a full build to move it to its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECENT, WINDOWS, HALF_LIVES, LOAD_DAYS = 50, (10, 25, 50), (5.0, 20.0), 14
RESULT = "match_id bigint, player_id bigint, opponent_id bigint, day int, surface string, won int, margin bigint, walkover boolean"
FORM = (
    "n bigint, " + ", ".join(f"win_rate_{n} double, margin_{n} double" for n in WINDOWS) + ", career_win_rate double, surface_n bigint, surface_win_rate double, "
    + ", ".join(f"ewma_{h:g} double" for h in HALF_LIVES) + f", rest_days int, matches_{LOAD_DAYS}d bigint, streak bigint, h2h_wins bigint, h2h_losses bigint, late boolean"
)
FRAME = f"match_id bigint, player_id bigint, {FORM}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME_ROW = Row(*[x.split()[0] for x in FRAME.split(", ")])
#: Parallel arrays: one entry a result, a surface and an opponent.
STATE = (
    "n bigint, wins bigint, last_day int, last_surface string, streak bigint, " + ", ".join(f"s{i} double, w{i} double" for i in range(len(HALF_LIVES)))
    + ", won array<int>, margin array<bigint>, day array<int>, surface array<string>, surface_n array<bigint>, surface_wins array<bigint>, opponent array<bigint>, met_wins array<bigint>, met_losses array<bigint>"
)


class _Last:
    """Sums of the last size results, kept by taking out what leaves: numbers are whole, so the means are those of the rows."""

    def __init__(self, size: int, won: list, margin: list):
        self.size, self.won, known = size, sum(won[-size:]), [x for x in margin[-size:] if x is not None]
        self.margin, self.known = sum(known), len(known)

    def means(self, n: int) -> tuple[float | None, float | None]:
        n = min(n, self.size)
        return self.won / n if n else None, self.margin / self.known if self.known else None

    def add(self, won: list, margin: list) -> None:
        """Takes in the last entries of won and margin."""
        self.won += won[-1]
        if margin[-1] is not None:
            self.margin, self.known = self.margin + margin[-1], self.known + 1
        if len(won) > self.size:
            self.won -= won[-1 - self.size]
            if margin[-1 - self.size] is not None:
                self.margin, self.known = self.margin - margin[-1 - self.size], self.known - 1


class PlayerForm(StatefulProcessor):
    """Emits FRAME for each result of a player, then folds it in. Walkovers are emitted only; a null margin (a retirement) counts as a result and not as a number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.form = handle.getValueState("form", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, wins, last_day, last_surface, streak, *rest = self.form.get() or (0, 0, None, None, 0, *[0.0] * (2 * len(HALF_LIVES)), *[[] for _ in range(9)])
        sums, (won, margin, days, *kept) = rest[:-9], map(list, rest[-9:])
        surfaces, meetings = (dict(zip(x[0], zip(*x[1:], strict=True), strict=True)) for x in (kept[:3], kept[3:]))
        windows, decay = [_Last(w, won, margin) for w in WINDOWS], [0.5 ** (1 / h) for h in HALF_LIVES]
        for match, _, opponent, day, surface, result, by, walkover in sorted(map(tuple, rows), key=itemgetter(3, 0)):  # columns of RESULT
            s, m = surfaces.get(surface, (0, 0)), meetings.get(opponent, (0, 0))
            means = [x for w in windows for x in w.means(len(won))]
            ewma = [sums[2 * i] / sums[2 * i + 1] if sums[2 * i + 1] else None for i in range(len(HALF_LIVES))]
            late = last_day is not None and day < last_day
            idle = None if last_day is None else max(0, day - last_day)
            since, same = day - LOAD_DAYS, surface == last_surface
            load = len([x for x in days[-RECENT:] if since <= x <= day])
            yield FRAME_ROW(match, key[0], n, *means, wins / n if n else None, s[0], s[1] / s[0] if s[0] else None, *ewma, idle, load, streak if same else 0, *m, late)
            if walkover:
                continue
            streak = streak + 1 if same else 1
            last_surface, last_day = surface, day if last_day is None else max(last_day, day)
            n, wins = n + 1, wins + result
            won.append(result)
            margin.append(by)
            days.append(day)
            for w in windows:
                w.add(won, margin)
            surfaces[surface], meetings[opponent] = (s[0] + 1, s[1] + result), (m[0] + result, m[1] + 1 - result)
            for i, keep in enumerate(decay):
                sums[2 * i], sums[2 * i + 1] = sums[2 * i] * keep + result * (1 - keep), sums[2 * i + 1] * keep + 1 - keep
        pairs = [y for x in (surfaces, meetings) for y in (list(x), [v[0] for v in x.values()], [v[1] for v in x.values()])]
        self.form.update((n, wins, last_day, last_surface, streak, *sums, won[-RECENT:], margin[-RECENT:], days[-RECENT:], *pairs))

    def close(self) -> None:
        pass


def form_stream(results: DataFrame) -> DataFrame:
    """FRAME of a stream of RESULT rows, two a match."""
    return results.select(*[x.split()[0] for x in RESULT.split(", ")]).groupBy("player_id").transformWithState(PlayerForm(), FRAME, "Append", "None")


def built(batch: DataFrame, folder: str) -> DataFrame:
    """Adds a batch of RESULT rows to those in folder, runs the stream from where it stopped to its end, and returns the rows of FRAME of all batches so far.

    Rows leave as (batch, row) Parquet, so a batch that is run again replaces itself.
    """
    spark = batch.sparkSession
    batch.write.mode("append").parquet(f"{folder}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        rows = form_stream(spark.readStream.schema(RESULT).parquet(f"{folder}/in"))
        write = lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
        rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/out").drop("batch")


def in_batches(results: DataFrame, folder: str, starts: list[int]) -> DataFrame:
    """``built`` for batches that begin at the match_ids of starts (the first begins at the first match)."""
    low, out = None, None
    for high in [*starts, None]:
        part = results.filter((F.lit(True) if low is None else F.col("match_id") >= low) & (F.lit(True) if high is None else F.col("match_id") < high))
        out, low = built(part, folder), high
    return out
