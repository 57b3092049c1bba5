"""Numbers and totals that follow an order, without a task that holds all rows or all rows of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def running_totals(rows: DataFrame, order: list[Column | str], values: dict[str, Column], by: list[str] = []) -> DataFrame:  # noqa: B006
    """rows with the totals of values over all earlier rows (of the same by), 0 for the first. Ties of order go in any order.

    Rows are range-sorted by (by, order) and written once, for both reads below need the same ranges. Totals run within
    a range; totals of ranges (a row a range and by) are summed apart and joined, so a group of any size spreads over many tasks.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    summed = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    placed = summed.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    parts = placed.groupBy("_part", *by).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy("_part", *by).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    here = placed.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_h_{n}") for n in values])
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return here.join(bases, same).select(*rows.columns, *[(F.col(f"_h_{n}") + F.col(f"_b_{n}")).alias(n) for n in values])


def numbered(rows: DataFrame, *order: Column | str, name: str = "seq", by: list[str] = []) -> DataFrame:  # noqa: B006
    """rows with a number from 1 on in the order given (within by)."""
    return running_totals(rows, list(order), {name: F.lit(1).cast("long")}, by).withColumn(name, F.col(name) + 1)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by and a double for each share (a name and a number from 0 to 1): exact quantiles, interpolated between neighbours, nulls skipped; groups without values have no row.

    Distinct values are counted first and their places come from totals over ranges, so no task holds the values of a group.
    """
    keys = by or ["_all"]
    known = rows.filter(F.col(value).isNotNull()).select(*([] if by else [F.lit(0).alias("_all")]), *by, F.col(value).cast("double").alias("_v"))
    counts = known.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    placed = running_totals(counts, ["_v"], {"_below": F.col("_c")}, keys)
    sizes = placed.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    rows = placed.alias("p").join(sizes.alias("s"), same).select("p.*", "_n")
    at = lambda place: F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_c")), F.col("_v")))
    found = []
    for name, share in shares.items():
        place = (F.col("_n") - 1) * F.lit(float(share))
        found += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    got = rows.groupBy(*[F.col(k) for k in keys]).agg(*found)
    between = lambda n: F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}")).otherwise((1 - F.col(f"_part_{n}")) * F.col(f"_lo_{n}") + F.col(f"_part_{n}") * F.col(f"_hi_{n}"))
    return got.select(*by, *[between(n).alias(n) for n in shares])
