"""Draw sheets from JSON: slots of the first round with byes, and matches anywhere in a payload."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the player that stands for a bye in the feed.
BYE = 3700
PLAYER = "struct<id: bigint, name: string, seed: string>"
SHEET = f"struct<data: struct<singles: array<struct<roundId: int, draw: int, result: string, seed1: string, seed2: string, player1Id: bigint, player2Id: bigint, player1: {PLAYER}, player2: {PLAYER}>>>>"
FOUND = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "player1", "player2")])


def first_round(sheets: DataFrame, payload: str = "payload", keep: list[str] = ["draw_id"]) -> DataFrame:  # noqa: B006
    """keep, slot, player_id, name, seed, is_bye of the first round; the real player of a bye takes the upper slot.

    A tie is a bye by its result's word or by the player who stands for one, on either side. A missing player
    who is not a bye keeps a placeholder slot (null player, no bye). Later rounds of the sheet are ignored.
    """
    ties = sheets.select(*keep, F.from_json(payload, SHEET).alias("s")).select(*keep, F.explode("s.data.singles").alias("t"))
    first = ties.withColumn("_first", F.min("t.roundId").over(Window.partitionBy(*keep))).filter("t.roundId = _first")
    stands = lambda i: F.coalesce((F.col(f"t.player{i}Id") == BYE) | (F.col(f"t.player{i}.id") == BYE), F.lit(False))
    side = lambda i: F.struct(F.col(f"t.player{i}.id").alias("id"), F.col(f"t.player{i}.name").alias("name"), F.coalesce(f"t.seed{i}", f"t.player{i}.seed").alias("seed"))
    bye = (F.lower(F.coalesce("t.result", F.lit(""))) == "bye") | stands(1) | stands(2)
    swap = stands(1) & ~stands(2)
    rows = first.select(*keep, F.col("t.draw").alias("tie"), bye.alias("bye"), F.posexplode(F.array(F.when(swap, side(2)).otherwise(side(1)), F.when(swap, side(1)).otherwise(side(2)))).alias("k", "p"))
    empty = F.col("bye") & (F.col("k") == 1)
    real = lambda c: F.when(~empty & ~F.coalesce(F.col("p.id") == BYE, F.lit(False)), F.col(f"p.{c}"))
    return rows.select(*keep, ((F.col("tie") - 1) * 2 + F.col("k")).alias("slot"), real("id").alias("player_id"), real("name").alias("name"), real("seed").alias("seed"), empty.alias("is_bye"))


def _walk(node, path: str = "$") -> Iterator[tuple[str, str, str]]:
    """Objects with two players, by either pair of names in any case; what lies inside such an object is its own."""
    if isinstance(node, dict):
        lower = {k.lower(): v for k, v in node.items()}
        for a, b in (("player1", "player2"), ("p1", "p2")):
            if a in lower and b in lower:
                yield path, json.dumps(lower[a]), json.dumps(lower[b])
                return
        for key, value in node.items():
            yield from _walk(value, f"{path}.{key}")
    elif isinstance(node, list):
        for i, value in enumerate(node):
            yield from _walk(value, f"{path}[{i}]")


@F.pandas_udf(T.ArrayType(FOUND))
def pairs_anywhere(payload: pd.Series) -> pd.Series:
    """Every object that holds two players, however deep, with its path; text that is no JSON has none."""

    def one(text):
        try:
            return [dict(zip(FOUND.names, x, strict=True)) for x in _walk(json.loads(text))]
        except (TypeError, ValueError):
            return []

    return payload.map(one)


def matches_anywhere(payloads: DataFrame, payload: str = "payload", keep: list[str] = ["draw_id"]) -> DataFrame:  # noqa: B006
    return payloads.select(*keep, F.explode(pairs_anywhere(payload)).alias("m")).select(*keep, "m.*")
