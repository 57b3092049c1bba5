"""From the chance of a point to the chance of a match.

Points are independent with one chance for each server. Games, two-point races and matches are closed forms and stay
Columns. Tiebreaks and sets are sums over paths on a grid of at most 7 x 7 scores; they run over whole
Arrow batches as numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the usual share of points won on serve.
AVERAGE_SERVE = 0.6386


def game(p: Column) -> Column:
    """Chance to hold serve: won to 0, 15 or 30, or from deuce."""
    q = 1 - p
    return F.pow(p, 4) * (1 + 4 * q + 10 * q * q) + 20 * F.pow(p * q, 3) * F.try_divide(p * p, p * p + q * q)


def race(a: Column, b: Column) -> Column:
    """Chance of the first to win two in a row out of pairs (own serve, other's serve)."""
    win, lose = a * (1 - b), (1 - a) * b
    return F.coalesce(F.try_divide(win, win + lose), F.lit(0.5))


def match(s: Column, best_of: Column) -> Column:
    """Chance of a match from the chance of a set, kept in [0, 1]."""
    three, five = s * s * (3 - 2 * s), F.pow(s, 3) * (10 - 15 * s + 6 * s * s)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(best_of >= 5, five).otherwise(three)))


def matchup(serve: Column, opponent_return: Column, average: float = AVERAGE_SERVE) -> Column:
    """Share of points won on serve against this returner."""
    return F.least(F.lit(0.90), F.greatest(F.lit(0.30), serve - opponent_return + 1 - average))


def _race(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    win, lose = a * (1 - b), (1 - a) * b
    total = win + lose
    return np.where(total > 0, win / np.where(total > 0, total, 1), 0.5)


def _hold(p: np.ndarray) -> np.ndarray:
    q = 1 - p
    both = p * p + q * q
    return p**4 * (1 + 4 * q + 10 * q * q) + 20 * (p * q) ** 3 * p * p / both


def tiebreak_of(a: np.ndarray, b: np.ndarray, target: int = 7) -> np.ndarray:
    """Chance of the first server in a tiebreak: reach[i][j] is the chance to stand at i to j."""
    n = target - 1
    reach = np.zeros((target + 1, target + 1, len(a)))
    reach[0, 0] = 1.0
    for i in range(target):
        for j in range(target):
            if i == n and j == n:
                continue  # level at target - 1: the race decides
            point = a if ((i + j + 1) // 2) % 2 == 0 else 1 - b
            reach[i + 1, j] += reach[i, j] * point
            reach[i, j + 1] += reach[i, j] * (1 - point)
    return reach[target, :n].sum(axis=0) + reach[n, n] * _race(a, b)


def set_of(a: np.ndarray, b: np.ndarray, tiebreak: bool = True) -> np.ndarray:
    """Chance of a set for the one who serves first."""
    hold, other = _hold(a), _hold(b)
    reach = np.zeros((8, 8, len(a)))
    reach[0, 0] = 1.0
    for total in range(12):
        for i in range(max(0, total - 6), min(6, total) + 1):
            j = total - i
            if max(i, j) == 6 and abs(i - j) >= 2:
                continue
            own = hold if total % 2 == 0 else 1 - other
            reach[i + 1, j] += reach[i, j] * own
            reach[i, j + 1] += reach[i, j] * (1 - own)
    level = tiebreak_of(a, b) if tiebreak else _race(hold, other)
    return reach[6, :5].sum(axis=0) + reach[7, 5] + reach[6, 6] * level


@F.pandas_udf(T.DoubleType())
def tiebreak_chance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(tiebreak_of(a.to_numpy(float), b.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def set_chance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(set_of(a.to_numpy(float), b.to_numpy(float)))
