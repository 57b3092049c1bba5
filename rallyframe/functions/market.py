"""Column functions of two-way prices: margin removal, expected value, stakes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kelly stakes are capped at this share, probabilities kept off 0 and 1 by this much.
KELLY_CAP = 0.05
EPS = 1e-15
POWER_STEPS = 60


def overround(o1: Column, o2: Column) -> Column:
    return 1 / o1 + 1 / o2


def vig_percent(over: Column) -> Column:
    """The book's margin from an overround, in percent."""
    return (1 - 1 / over) * 100


def proportional(o1: Column, o2: Column) -> Column:
    """First side's probability, the margin taken in proportion."""
    return (1 / o1) / overround(o1, o2)


def shin_z(o1: Column, o2: Column) -> Column:
    """Share of insiders in closed form for two outcomes; 0 where the book has no margin."""
    total, gap = overround(o1, o2), 1 / o1 - 1 / o2
    z = ((total - 1) * (gap * gap - total)) / (total * (gap * gap - 1))
    return F.when(total > 1, z).otherwise(0.0)


def shin(o1: Column, o2: Column) -> Column:
    """First side's probability with Shin's model: for two outcomes each side gives up half of the margin."""
    total = overround(o1, o2)
    return F.when(total >= 1, 1 / o1 - (total - 1) / 2).otherwise(proportional(o1, o2))


def power(o1: Column, o2: Column) -> Column:
    """First side's probability with a common exponent, found by bisection inside one expression."""
    a, b = 1 / o1, 1 / o2
    start = F.struct(F.lit(0.2).alias("lo"), F.lit(3.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        high = F.pow(a, mid) + F.pow(b, mid) > 1
        return F.struct(F.when(high, mid).otherwise(s["lo"]).alias("lo"), F.when(high, s["hi"]).otherwise(mid).alias("hi"))

    k = F.aggregate(F.sequence(F.lit(1), F.lit(POWER_STEPS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.pow(a, k) / (F.pow(a, k) + F.pow(b, k))


def expected_value(p: Column, price: Column) -> Column:
    return p * price - 1


def kelly(p: Column, price: Column) -> Column:
    """Share of the bank: (p b - q) / b between 0 and KELLY_CAP; 0 at a price that wins nothing, null without a chance or a price."""
    b = price - 1
    share = F.coalesce((p * b - (1 - p)) / F.when(b > 0, b), F.lit(0.0))
    return F.when(p.isNotNull() & price.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(KELLY_CAP), share)))


def clipped(p: Column, eps: float = EPS) -> Column:
    """p within eps of 0 and 1; no chance stays none (least and greatest would pass over it)."""
    return F.when(p.isNotNull(), F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p)))


def log_loss(y: Column, p: Column, eps: float = EPS) -> Column:
    q = clipped(p, eps)
    return -F.avg(F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
