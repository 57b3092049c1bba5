"""Form features from rows in play order: every value comes from rows strictly before its own.

All windows of a function share one partitioning and order, so Spark sorts once; frames differ at no cost.
Missing numbers are skipped, and a rolling value over "the last N with statistics" is made on those
rows alone and carried forward.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLLING = (10, 25, 50)
SESSION_DAYS = 30


def before(w: WindowSpec, n: int | None = None) -> WindowSpec:
    """The n rows before the current one, or all of them."""
    return w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def rolling(x: Column, w: WindowSpec, sizes: tuple[int, ...] = ROLLING, name: str = "win_rate") -> list[Column]:
    return [F.round(F.avg(x).over(before(w, n)), 6).alias(f"{name}_{n}") for n in sizes]


def sessions(df: DataFrame, key: list[str], day: str, order: list[str], out: str = "edition", gap: int = SESSION_DAYS) -> DataFrame:
    """df with the number of its session: a new one after more than ``gap`` days without a row."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = F.when(F.datediff(F.col(day), F.lag(day).over(w)) > gap, 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def streak(df: DataFrame, key: list[str], value: str, order: list[str], out: str = "streak") -> DataFrame:
    """How many rows in a row before this one had this row's value, counted back to the last switch."""
    w = Window.partitionBy(*key).orderBy(*order)
    island = F.sum(F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_island", island)
    return marked.withColumn(out, F.row_number().over(Window.partitionBy(*key, "_island").orderBy(*order)).cast("long") - 1).drop("_island")


def load_before(key: list[str], day: str, order: list[str], days: int, amount: Column | None = None) -> Column:
    """Rows (or their amounts) of a key in the last ``days`` days before this row, in the order (day, order).

    A frame by days takes whole days; what the row's own day has from this row on is taken off again. Frames, so no row is copied.
    """
    x = F.lit(1) if amount is None else amount
    by_day = Window.partitionBy(*key).orderBy(F.unix_date(F.col(day))).rangeBetween(-days, 0)
    from_here = Window.partitionBy(*key, day).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.sum(x).over(by_day), F.lit(0)) - F.coalesce(F.sum(x).over(from_here), F.lit(0))


def _states_before(x: np.ndarray, same: np.ndarray, keep: float, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum and weight of an exponential mean before each value of x, and those after the last one.

    same: whether a value's key is that of the value before (of ``carried``, for the first). A step is a linear map of the state;
    maps are composed over stretches of doubling length, so a batch takes few passes.
    """
    there = ~np.isnan(x)
    factor, own = np.where(there, keep, 1.0), np.stack([np.where(there, x, 0.0), there]) * (1 - keep)
    a = np.where(same, np.concatenate([[1.0], factor[:-1]]), 0.0)
    b = np.where(same, np.concatenate([carried[:, None], own[:, :-1]], axis=1), 0.0)
    step = 1
    while step < len(x) and a[step:].any():
        b[:, step:] += a[step:] * b[:, :-step].copy()
        a[step:] *= a[:-step].copy()
        step *= 2
    return b, factor[-1] * b[:, -1] + own[:, -1]


def ewma_before(rows: DataFrame, key: list[str], order: str, value: str, half_lives: tuple[float, ...] = (5.0, 20.0)) -> DataFrame:
    """key, order and ewma_h for each half-life: the bias-corrected mean of all earlier values of the key, missing ones skipped; null before the first.

    Rows stream in order through vectorised steps, a batch at a time; what goes from one batch to the next is a key and two numbers a half-life.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f"ewma_{h:g}" for h in half_lives]
    rows = rows.select(*key, order, F.col(value).cast("double").alias("_x"))
    whole = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, T.DoubleType()) for n in names]])
    arrow, keeps = to_arrow_schema(whole), [0.5 ** (1 / h) for h in half_lives]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [np.zeros(2) for _ in keeps]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i) for i in range(len(key))]
            same = np.ones(batch.num_rows, bool)
            same[0] = last == [c[0].as_py() for c in own]
            for c in own:
                code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                same[1:] &= code[1:] == code[:-1]
            x = batch.column(len(key) + 1).to_numpy(zero_copy_only=False).astype(float)
            means = []
            for h, keep in enumerate(keeps):
                (s, w), carried[h] = _states_before(x, same, keep, carried[h])
                means.append(pa.array(s / np.where(w > 0, w, 1.0), pa.float64(), mask=w == 0))
            last = [c[-1].as_py() for c in own]
            yield pa.RecordBatch.from_arrays([*own, batch.column(len(key)), *means], schema=arrow)

    return rows.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(run, whole)


def head_to_head(results: DataFrame, by: list[str] = [], order: list[str] = ["match_id"]) -> DataFrame:  # noqa: B006
    """results with the winner's earlier wins and losses against this loser (within by)."""
    lo, hi = F.least("winner_id", "loser_id"), F.greatest("winner_id", "loser_id")
    w = Window.partitionBy(lo, hi, *by).orderBy(*order)
    lower_won = F.when(F.col("winner_id") == lo, 1).otherwise(0)
    total, lower = F.count("*").over(before(w)), F.coalesce(F.sum(lower_won).over(before(w)), F.lit(0))
    own = F.when(F.col("winner_id") == lo, lower).otherwise(total - lower)
    return results.withColumn("h2h_wins", own.cast("long")).withColumn("h2h_losses", (total - own).cast("long"))


def carried(x: Column, w: WindowSpec) -> Column:
    """The last value that is not null before the current row."""
    return F.last(x, ignorenulls=True).over(before(w))


def first_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the order, by an aggregation on structs rather than a sort of the group."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_r"))).alias("_s"))
    return picked.select(*key, *[F.col("_s._r")[c].alias(c) for c in rest])


def season_of(day: Column) -> Column:
    """The season a day belongs to: a new one starts on 25 December."""
    return F.when((F.month(day) == 12) & (F.dayofmonth(day) >= 25), F.year(day) + 1).otherwise(F.year(day)).cast("long")
