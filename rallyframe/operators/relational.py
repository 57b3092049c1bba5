"""Joins, matching and table maintenance over DataFrames.

Shuffles are on the keys that are named. Small sides are left to Spark's own size check: no
hint forces a broadcast of a table whose size is not known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written


def pair_key(a: str, b: str) -> list[Column]:
    """Two columns that are equal for (a, b) and (b, a)."""
    return [F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi")]


def banded_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int, left_id: str, right_id: str, low: int | None = None) -> DataFrame:
    """keys, left_id, right_id, gap: one-to-one matches on keys with days apart in [low, days], nearest first.

    Two passes: the best right row of each left row, then the best left row of each right row; ties go to smaller ids. Which right row is best depends on the keys and the day alone, so
    only the smallest right_id of each (keys, day) can win, and distinct (keys, day) of both sides meet instead of rows: a left one meets 2 * days + 1 at most, however many rows share
    a key. They meet by keys and a stretch of days as wide as the band: each right day goes to the stretches that it reaches, two or three.
    """
    lowest = -days if low is None else low
    width = max(1, days - lowest)
    day = lambda c: F.unix_date(F.to_date(c))
    stretch = lambda c: F.floor(c / width)
    lefts = left.filter(F.col(left_day).isNotNull()).select(*keys, left_id, day(left_day).alias("_a"))
    rights = right.filter(F.col(right_day).isNotNull()).groupBy(*keys, day(right_day).alias("_b")).agg(F.min(right_id).alias(right_id))
    reached = F.explode(F.sequence(stretch(F.col("_b") - days), stretch(F.col("_b") - lowest)))
    near = lefts.select(*keys, "_a").distinct().withColumn("_s", stretch(F.col("_a"))).join(rights.select("*", reached.alias("_s")), [*keys, "_s"])
    near = near.withColumn("gap", F.col("_b") - F.col("_a")).filter(F.col("gap").between(lowest, days))
    best = near.groupBy(*keys, "_a").agg(F.min(F.struct(F.abs("gap").alias("g"), right_id, "gap")).alias("m")).select(*keys, "_a", F.col("m")[right_id].alias(right_id), "m.gap")
    first = lefts.join(best, [*keys, "_a"]).groupBy(left_id).agg(F.min_by(F.struct(*keys, right_id, "gap"), F.struct(F.abs("gap").alias("g"), right_id, "gap")).alias("m")).select(left_id, "m.*")
    second = first.groupBy(right_id).agg(F.min_by(F.struct(*keys, left_id, "gap"), F.struct(F.abs("gap").alias("g"), left_id)).alias("m")).select("m.*", right_id)
    return second.select(*keys, left_id, right_id, F.col("gap").cast("long").alias("gap"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], strict: bool = True) -> DataFrame:
    """left with the values of the last right row of its key before (or at) its own time.

    Both sides go into one window by key and time; nothing is joined, so a key's history is sorted
    once and a busy key costs a sort and not a product. Right rows that share a time: the greatest values win.
    """
    rank = F.lit(0) if strict else F.lit(1)
    rows = left.select(F.col(key).alias("_k"), F.col(left_at).alias("_t"), rank.alias("_r"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_right"))
    history = right.select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), (F.lit(1) - rank).alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy("_k").orderBy("_t", "_r", F.col("_right").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(history).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_left is not null")
    return found.select("_left.*", *[F.col("_found")[v].alias(v) for v in values])


def set_similarity(sets: DataFrame, entity: str, item: str, least: float) -> DataFrame:
    """a, b, shared, jaccard of entities a < b that share an item and reach ``least``.

    Prefix filtering: items are ordered from rare to common, and a pair that reaches ``least`` shares one among the first
    n - ceil(least n) + 1 items of each; common items never join, so an item that many share makes no product.
    Only ids travel through that join; items follow for the pairs it leaves.
    """
    rows = sets.select(entity, item).distinct()
    freq = rows.groupBy(item).agg(F.count("*").alias("f"))
    ordered = rows.join(freq, item).groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("f", item))).alias("items"))
    n = F.size("items")
    prefix = ordered.select(entity, F.transform("items", lambda x: x[item]).alias("items"), F.slice("items", F.lit(1), n - F.ceil(n * least).cast("int") + 1).alias("p"))
    prefix = written(prefix, "prefixes")  # read by both sides of the join, and for the items of its pairs
    probe = prefix.select(entity, n.alias("n"), F.explode("p").alias("x")).select(entity, "n", F.col("x")[item].alias("x"))
    a = probe.select(F.col(entity).alias("a"), F.col("n").alias("na"), "x")
    b = probe.select(F.col(entity).alias("b"), F.col("n").alias("nb"), "x")
    sizes_fit = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    pairs = a.join(b, "x").filter((F.col("a") < F.col("b")) & sizes_fit).select("a", "b").distinct()
    pairs = pairs.join(prefix.select(F.col(entity).alias("a"), F.col("items").alias("ia")), "a").join(prefix.select(F.col(entity).alias("b"), F.col("items").alias("ib")), "b")
    shared = F.size(F.array_intersect("ia", "ib"))
    out = pairs.select("a", "b", shared.cast("long").alias("shared"), (shared / (F.size("ia") + F.size("ib") - shared)).alias("jaccard"))
    return out.filter(F.col("jaccard") >= least)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """Rows of both; of equal keys (nulls equal nulls) the newest new row, else the old one."""
    tagged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    picked = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", newest)).alias("_r"))
    return picked.select(*[c if c in keys else F.col("_r")[c].alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it does not have; the first wins."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys).select(*old.columns))


def update_from(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with columns taken from new where it has the key and a value."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(fresh, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in old.columns])


def replace_scope(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """old without the rows of the scopes that new brings, and new."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def in_every(df: DataFrame, group: str, member: str) -> DataFrame:
    """Rows whose member occurs in every group: a common sample across groups."""
    groups = df.agg(F.countDistinct(group)).first()[0]
    common = df.groupBy(member).agg(F.countDistinct(group).alias("_n")).filter(F.col("_n") == groups).select(member)
    return df.join(common, member, "left_semi")


def lookup(rows: DataFrame, out: str, *sources: tuple[str, DataFrame, str, str]) -> DataFrame:
    """rows with ``out`` from the first source that has the row's key; a source is (column, table, key, value)."""
    names = []
    for i, (column, source, key, value) in enumerate(sources):
        one = source.groupBy(F.col(key).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        rows = rows.join(one, F.col(column) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        names.append(f"_v{i}")
    return rows.withColumn(out, F.coalesce(*names)).drop(*names)


def resolved(names: DataFrame, players: DataFrame) -> DataFrame:
    """name, player_id, level of each different name (id, name; players: player_id, name, last_seen): by the whole plain name (0), by surname and initial (1), or by any later word as the surname
    with the first word's initial (2 and on, in their order); null where none fits, or the name is null or blank.

    One index of keys to players, one list of ranked keys a name, one join and the lowest rank. Where players share a key the one seen last has it, then the smaller id.
    """
    plain, surname = tx.plain_name(F.col("plain"), folded=True), tx.surname_key(F.col("plain"), folded=True)
    key = lambda kind, x: F.concat(F.lit(kind), x)
    known = players.select("player_id", F.coalesce("last_seen", F.lit(-(1 << 62))).alias("seen"), tx.unaccented(F.col("name")).alias("plain"))
    index = known.select("player_id", "seen", F.explode(F.array(key("n", plain), key("s", surname))).alias("key")).filter(F.length("key") > 1)
    index = index.groupBy("key").agg(F.max_by("player_id", F.struct("seen", -F.col("player_id"))).alias("player_id"))
    long = F.filter(F.split(plain, " "), lambda w: F.length(w) > 1)
    later = F.when(F.size(long) > 2, F.transform(F.slice(long, 2, F.size(long)), lambda w: key("s", F.concat_ws("|", w, F.substring(F.get(long, 0), 1, 1))))).otherwise(F.array())
    asked = names.select("name").distinct().withColumn("plain", tx.unaccented(F.col("name")))
    ranked = asked.select("name", F.posexplode(F.concat(F.array(key("n", plain), key("s", surname)), later)).alias("level", "key")).filter(F.length("key") > 1)
    best = ranked.join(index, "key").groupBy("name").agg(F.min_by("player_id", "level").alias("player_id"), F.min("level").alias("level"))
    found = names.withColumn("_n", F.col("name")).drop("player_id", "level").join(best.withColumnRenamed("name", "_n"), "_n", "left")
    return found.drop("_n")


def best_in_band(left: DataFrame, right: DataFrame, days: int = 10, least: float = 0.2) -> DataFrame:
    """left_id, right_id, jaccard, gap: for each left entity the right one of the most similar set within ``days`` of it, if ``least`` or more.

    Both sides: id, day (a number), items (an array without repeats). The nearer day, then the smaller id goes first among equals. Rows meet by item and
    stretch of days, the right side in its own and both neighbouring stretches, so that pairs are few where days are many.
    """
    stretch = F.floor(F.col("day") / days)
    a = left.select(F.col("id").alias("left_id"), F.col("day").alias("a_day"), F.size("items").alias("a_size"), stretch.alias("stretch"), F.explode("items").alias("item"))
    b = right.select(F.col("id").alias("right_id"), F.col("day").alias("b_day"), F.size("items").alias("b_size"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"), "items")
    b = b.withColumn("item", F.explode("items")).drop("items")
    gap = F.abs(F.col("a_day") - F.col("b_day"))
    shared = a.join(b, ["item", "stretch"]).filter(gap <= days).groupBy("left_id", "right_id", "a_size", "b_size", gap.alias("gap")).agg(F.count("*").alias("both"))
    scored = shared.withColumn("jaccard", F.col("both") / (F.col("a_size") + F.col("b_size") - F.col("both"))).filter(F.col("jaccard") >= least)
    best = scored.groupBy("left_id").agg(F.max(F.struct("jaccard", (-F.col("gap")).alias("g"), (-F.col("right_id")).alias("r"))).alias("x"))
    return best.select("left_id", (-F.col("x.r")).alias("right_id"), "x.jaccard", (-F.col("x.g")).alias("gap"))
