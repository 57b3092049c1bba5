"""Column functions of names, labels, dates and scores."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a score holds where it ended early, strongest first, and tokens that are no sets.
ENDINGS = (("walkover", "W/O|^ *W *O *$"), ("default", "DEF"), ("retired", "RET"), ("unfinished", "ABN|ABD|UNFINISHED"))
NO_SET = ("RET", "DEF", "W/O", "ABN", "ABD", "(RET)", "-")
SET = r"^(\d{1,2})-(\d{1,2})(?:\((\d+)\))?$"
#: Games beyond which a side of a set is a slip of the pen.
MOST_GAMES = 30
# Codes of levels and surfaces, and the order of rounds.
LEVELS = {"G": "slam", "M": "masters", "F": "finals", "500": "500", "250": "250", "A": "main", "D": "team", "O": "olympics", "C": "challenger"}
ROUNDS = ("Q1", "Q2", "Q3", "R128", "R64", "R32", "R16", "QF", "SF", "BR", "F", "RR")


@F.pandas_udf(T.StringType())
def unaccented(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; each different name of a batch is folded once."""
    known = {x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in names.dropna().unique() if not x.isascii()}
    return names.replace(known) if known else names


def plain_name(name: Column, folded: bool = False) -> Column:
    """Lower case without accents; hyphens and dots are spaces, apostrophes go, runs of white space are one; null counts as empty. folded: accents are gone already."""
    x = F.lower(F.coalesce(name if folded else unaccented(name), F.lit("")))
    return F.trim(F.regexp_replace(F.translate(x, "-.'", "  "), r"\s+", " "))


def slug(name: Column, folded: bool = False) -> Column:
    return F.regexp_replace(F.regexp_replace(plain_name(name, folded), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# Words of a tournament's name that are not its city.
NOT_CITY = (" Challenger", " Open", " Masters", " Cup", " Championships")


def tour_of(tournament: Column) -> Column:
    """wta, challenger or atp, by words in a tournament's name."""
    low = F.lower(F.coalesce(tournament, F.lit("")))
    return F.when(F.contains(low, F.lit("wta")), "wta").when(F.contains(low, F.lit("challenger")), "challenger").otherwise("atp")


def tournament_slug(name: Column) -> Column:
    """The slug of a tournament's city: what follows the last dash, without the words that are not its own."""
    return slug(F.regexp_replace(F.substring_index(F.coalesce(name, F.lit("")), " - ", -1), "|".join(NOT_CITY), ""))


def without_seed(name: Column) -> Column:
    return F.trim(F.substring_index(name, "(", 1))


def clock(cell: Column) -> Column:
    """The time at the head of a cell that may hold more, or null."""
    found = F.regexp_extract(F.coalesce(cell, F.lit("")), r"^\s*(\d{1,2}:\d\d)", 1)
    return F.when(found != "", found)


def surname_key(name: Column, folded: bool = False) -> Column:
    """``surname|initial`` of "First Last" and of "Last F." alike: single letters are initials.

    A single word is its own key; initials alone give the first of them; nothing gives an empty key.
    """
    words = F.filter(F.split(plain_name(name, folded), " "), lambda w: w != "")
    initials, long = F.filter(words, lambda w: F.length(w) == 1), F.filter(words, lambda w: F.length(w) > 1)
    last, first = F.element_at(long, -1), F.coalesce(F.get(initials, 0), F.substring(F.get(long, 0), 1, 1))
    single = (F.size(long) == 1) & (F.size(initials) == 0)
    return F.when(F.size(long) == 0, F.coalesce(F.get(words, 0), F.lit(""))).when(single, last).otherwise(F.concat_ws("|", last, first))


def mapped(code: Column, values: dict[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), F.lit(default))


def number(x: Column) -> Column:
    """A double, or null where the text is no number."""
    return F.trim(x).try_cast("double")


def day_of(yyyymmdd: Column) -> Column:
    return F.try_to_date(yyyymmdd.cast("string"), "yyyyMMdd")


def ordinal(yyyymmdd: Column) -> Column:
    """A number of days; a month or day of 0 counts as 1."""
    month, day = F.greatest(F.lit(1), F.floor(yyyymmdd / 100) % 100), F.greatest(F.lit(1), yyyymmdd % 100)
    return F.datediff(F.make_date(F.floor(yyyymmdd / 10000).cast("int"), month.cast("int"), day.cast("int")), F.lit("0001-01-01").cast("date")) + 1


def score_status(score: Column, n_sets: Column) -> Column:
    """How a match ended; a score without sets and without such a word is unfinished."""
    upper, out = F.upper(F.coalesce(score, F.lit(""))), None
    for name, pattern in ENDINGS:
        hit = F.regexp_like(upper, F.lit(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(n_sets == 0, "unfinished").otherwise("completed")


def with_score(rows: DataFrame, score: str) -> DataFrame:
    """rows with status, sets (array<struct<w, l, tb>>), n_sets, games, margin, tiebreaks, usable of a column of scores.

    Brackets go; a token that is neither a set nor a word of an ending, and a set with more than MOST_GAMES, is left out and spoils the score.
    A walkover has no sets. A score is usable if it is complete and unspoilt, the winner took two or three sets, more than the loser and the last one, of five at most.
    Each step is a column of its own, so that a score is split and matched once.
    """
    text = F.coalesce(F.col(score), F.lit(""))
    part = lambda t, i: F.regexp_extract(t, SET, i).try_cast("int")
    tokens = F.filter(F.split(F.translate(text, "[]", ""), r"\s+"), lambda t: (t != "") & ~F.upper(t).isin(*NO_SET))
    read = lambda t: F.when(F.regexp_like(t, F.lit(SET)), F.struct(part(t, 1).alias("w"), part(t, 2).alias("l"), part(t, 3).alias("tb")))
    out = rows.withColumn("_read", F.transform(tokens, read)).withColumn("_good", F.filter("_read", lambda x: x.isNotNull() & (x["w"] <= MOST_GAMES) & (x["l"] <= MOST_GAMES)))
    out = out.withColumn("status", score_status(F.col(score), F.size("_good"))).withColumn("sets", F.when(F.col("status") == "walkover", F.slice("_good", 1, 0)).otherwise(F.col("_good")))
    total = lambda f: F.aggregate("sets", F.lit(0), lambda a, x: a + f(x))
    won, lost = F.size(F.filter("sets", lambda x: x["w"] > x["l"])), F.size(F.filter("sets", lambda x: x["l"] > x["w"]))
    last = F.get("sets", F.size("sets") - 1)
    whole = (F.col("status") == "completed") & (F.size("_read") == F.size("_good")) & (F.size("sets") <= 5)
    usable = whole & (won > lost) & won.isin(2, 3) & (lost <= 2) & (last["w"] > last["l"])
    figures = {
        "n_sets": F.size("sets"), "games": total(lambda x: x["w"] + x["l"]), "margin": total(lambda x: x["w"] - x["l"]), "tiebreaks": F.size(F.filter("sets", lambda x: x["tb"].isNotNull())),
        "usable": F.coalesce(usable, F.lit(False)),
    }
    return out.withColumns(figures).drop("_read", "_good")


def is_qualifying(round_name: Column) -> Column:
    """Rounds Q1, Q2 and so on; a quarter-final (QF) begins with the same letter and is not one."""
    upper = F.upper(F.coalesce(round_name, F.lit("")))
    return F.startswith(upper, F.lit("Q")) & (upper != "QF")


def lower_first(id_column: Column) -> Column:
    """Whether the first listed side goes first: by the parity of an md5's first byte, so not by the outcome."""
    return F.conv(F.substring(F.md5(id_column.cast("string")), 1, 2), 16, 10).cast("int") % 2 == 0
