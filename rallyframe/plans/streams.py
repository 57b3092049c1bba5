"""Queries on streams, pages and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import drawsheets, pages
from ..streaming import flows
from .registry import query
from .views import table


@query(
    "stream_windows",
    "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def stream_windows(spark, d):
    rows = flows.run_now(flows.windowed(flows.event_stream(spark, d)), shared_path(spark, "windows"))
    return flows.settled(rows, ["start", "event_type"]).select(F.substring(F.col("start").cast("string"), 1, 10).alias("day"), "event_type", "n", "total")


@query(
    "stream_latest",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
)
def stream_latest(spark, d):
    return flows.settled(flows.run_now(flows.latest(flows.event_stream(spark, d), "user_id"), shared_path(spark, "latest")), ["user_id"])


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS e FROM g)
SELECT user_id, count(DISTINCT e) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, e, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id""",
)
def stream_sessions(spark, d):
    rows = flows.run_now(flows.editions(flows.event_stream(spark, d), "12 hours"), shared_path(spark, "sessions"), "complete")
    rows = flows.newest(rows)  # complete mode writes all sessions in each batch, as late rows may have moved them
    return rows.groupBy("user_id").agg(F.countDistinct("start").alias("sessions"), F.max("n").alias("longest"))


@query("stream_first_rows", "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY ALL")
def stream_first_rows(spark, d):
    rows = flows.run_now(flows.without_repeats(flows.event_stream(spark, d), ["user_id", "event_type"]), shared_path(spark, "first"), "append")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


FORM = """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
e(user_id, i, s, w) AS (SELECT user_id, i, value * (1 - pow(0.5e0, 1/20e0)), 1 - pow(0.5e0, 1/20e0) FROM r WHERE i = 1
UNION ALL SELECT r.user_id, r.i, s * pow(0.5e0, 1/20e0) + value * (1 - pow(0.5e0, 1/20e0)), w * pow(0.5e0, 1/20e0) + 1 - pow(0.5e0, 1/20e0) FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1)
SELECT user_id, max(i) AS n, round(arg_max(s / w, i), 6) AS form FROM e GROUP BY user_id"""


@query("stream_running_form", FORM)
def stream_running_form(spark, d):
    rows = flows.settled(flows.run_now(flows.running_form(flows.event_stream(spark, d)), shared_path(spark, "form")), ["user_id"])
    return rows.select("user_id", "n", F.round("form", 6).alias("form"))


@query(
    "source_links",
    """SELECT page_id, i, regexp_extract(row, '(?i)href="([^"]*)"', 1) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*>')) AS row, generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*>'), 1) AS i FROM pages)""",
)
def source_links(spark, d):
    return pages.links(table(spark, d, "pages")).select("page_id", F.col("i").cast("long").alias("i"), "href")


@query(
    "source_slugs",
    r"""SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([A-Za-z0-9\-]+)', 1)) AS slug FROM pages""",
)
def source_slugs(spark, d):
    return pages.slugs(table(spark, d, "pages"), 'href="/')


@query("source_json_walk", "SELECT event_id, '$.data.rows[0]' AS path, CAST(user_id AS VARCHAR) AS player1, CAST(event_id AS VARCHAR) AS player2 FROM events")
def source_json_walk(spark, d):
    """Objects with two players, anywhere in documents made from the events' own payloads."""
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.struct(F.array(F.struct(F.col("user_id").alias("p1"), F.col("event_id").alias("p2"))).alias("rows")).alias("data"))).alias("payload"))
    return drawsheets.matches_anywhere(e, keep=["event_id"])
