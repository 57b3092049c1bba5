"""Registered queries: a DataFrame plan and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL of the derived views, in the order in which they may refer to each other.
VIEWS = {
    "contest": """contest AS (
  SELECT CAST(FLOOR(a.event_id / 2) AS BIGINT) AS match_id, a.ts AS ts, a.event_type AS surface,
    CASE WHEN a.value >= b.value THEN a.user_id ELSE b.user_id END AS winner_id,
    CASE WHEN a.value >= b.value THEN b.user_id ELSE a.user_id END AS loser_id,
    ABS(a.value - b.value) AS margin, a.value + b.value AS total, b.event_type = 'error' AS retired
  FROM events a JOIN events b ON b.event_id = a.event_id + 1
  WHERE a.event_id % 2 = 0 AND a.user_id <> b.user_id)""",
    "player_match": """player_match AS (
  SELECT match_id, ts, surface, winner_id AS player_id, loser_id AS opponent_id, 1 AS won, margin, total, retired FROM contest
  UNION ALL SELECT match_id, ts, surface, loser_id, winner_id, 0, margin, total, retired FROM contest)""",
    "price": """price AS (
  SELECT l_orderkey AS match_id, l_suppkey % 12 AS book, l_linenumber AS ln, l_shipdate AS captured_at,
    1.2e0 + (l_partkey % 40) * 1e-1 AS p1_price, 1 / ((1.02e0 + l_tax) - 1 / (1.2e0 + (l_partkey % 40) * 1e-1)) AS p2_price,
    l_partkey AS k1, l_suppkey AS k2, l_quantity AS k3, l_extendedprice AS k4
  FROM lineitem)""",
    "forecast": """forecast AS (
  SELECT o_orderkey AS match_id, o_orderdate AS play_ts, CAST(YEAR(o_orderdate) AS BIGINT) AS season, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS y_win,
    LEAST(95e-2, GREATEST(5e-2, o_totalprice / 500000)) AS p_win, o_orderpriority AS surface, o_custkey AS player_id FROM orders)""",
    "closing": """closing AS (
  SELECT match_id, p1_price, p2_price FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY captured_at DESC, ln, k1, k2, k3, k4) AS place FROM price) WHERE place = 1)""",
    "opening": """opening AS (
  SELECT match_id, p1_price AS p1_open, p2_price AS p2_open FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY captured_at, ln, k1, k2, k3, k4) AS place FROM price) WHERE place = 1)""",
    "priced": """priced AS (
  SELECT f.*, c.p1_price, c.p2_price, 1 / c.p1_price + 1 / c.p2_price AS overround FROM forecast f JOIN closing c USING (match_id))""",
}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Registers a plan; views names the derived views that sql refers to."""

    def add(plan: Query) -> Query:
        QUERIES[name] = plan
        if sql:
            chosen = views.split()
            prefix = ", ".join(VIEWS[v] for v in VIEWS if v in chosen)
            body = sql.strip()
            if prefix:
                word = "WITH RECURSIVE" if body.startswith("WITH RECURSIVE ") else "WITH"
                body = f"{word} {prefix}, {body[len(word) + 1 :]}" if body.startswith("WITH ") else f"WITH {prefix} {body}"
            ORACLES[name] = body
        return plan

    return add
