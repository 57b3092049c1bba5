"""Queries on the incremental frame, captures before play, and the flow of captures into results."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import pages
from ..streaming import captures, frame, ledger
from .captures import said
from .registry import query
from .views import contest, player_match, table


def form_results(spark, d):
    """Two RESULT rows a contest; a retirement has no margin."""
    rows = player_match(contest(spark, d))
    return rows.select(
        "match_id", "player_id", "opponent_id", F.unix_date(F.to_date("ts")).alias("day"), "surface", "won", F.when(~F.col("retired"), F.round(F.col("margin") * 100).cast("long")).alias("margin"), F.lit(False).alias("walkover")
    )


def frame_sql() -> str:
    order = "PARTITION BY player_id ORDER BY day, match_id"
    before = lambda n: f"OVER ({order} ROWS BETWEEN {n or 'UNBOUNDED'} PRECEDING AND 1 PRECEDING)"
    means = ", ".join(f"round(avg(won) {before(n)}, 6) AS win_rate_{n}, round(avg(margin) {before(n)}, 4) AS margin_{n}" for n in frame.WINDOWS)
    ewma = ", ".join(f"round(sum(won * pow(2e0, i / {h}e0)) {before(None)} / sum(pow(2e0, i / {h}e0)) {before(None)}, 6) AS ewma_{h:g}" for h in map(int, frame.HALF_LIVES))
    return f"""WITH b AS (SELECT match_id, player_id, opponent_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, surface, won, CASE WHEN NOT retired THEN CAST(round(margin * 100) AS BIGINT) END AS margin FROM player_match),
i AS (SELECT *, row_number() OVER ({order}) AS i, CASE WHEN surface IS NOT DISTINCT FROM lag(surface) OVER ({order}) THEN 0 ELSE 1 END AS fresh FROM b),
j AS (SELECT *, sum(fresh) OVER ({order}) AS island FROM i)
SELECT match_id, player_id, i - 1 AS n, {means}, round(avg(won) {before(None)}, 6) AS career_win_rate,
  count(*) OVER (PARTITION BY player_id, surface ORDER BY day, match_id) - 1 AS surface_n, round(avg(won) OVER (PARTITION BY player_id, surface ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS surface_win_rate,
  {ewma}, CAST(day - lag(day) OVER ({order}) AS INT) AS rest_days,
  least({frame.RECENT}, count(*) OVER (PARTITION BY player_id ORDER BY day RANGE BETWEEN {frame.LOAD_DAYS} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY player_id, day ORDER BY match_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS matches_{frame.LOAD_DAYS}d,
  row_number() OVER (PARTITION BY player_id, island ORDER BY day, match_id) - 1 AS streak,
  CAST(coalesce(sum(won) OVER h, 0) AS BIGINT) AS h2h_wins, CAST(coalesce(sum(1 - won) OVER h, 0) AS BIGINT) AS h2h_losses, false AS late
FROM j WINDOW h AS (PARTITION BY player_id, opponent_id ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("stream_feature_frame", frame_sql(), "contest player_match")
def stream_feature_frame(spark, d):
    """The frame of all results, built in three batches, each of which goes on from the checkpoint of the one before."""
    rows = form_results(spark, d)
    last = rows.agg(F.max("match_id")).first()[0] or 0
    out = frame.in_batches(rows, shared_path(spark, "frame"), [last // 3, last * 2 // 3])
    round_ = lambda c: F.round(c, 4 if c.startswith("margin") else 6).alias(c)
    return out.select(*[round_(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in out.schema])


BATCHES = 5


@query(
    "stream_last_captures",
    """WITH r AS (SELECT o_orderkey AS match_id, o_orderdate + INTERVAL 60 DAY AS play_ts FROM orders),
c AS (SELECT l_orderkey AS match_id, l_shipdate AS captured_at, 1.2e0 + (l_partkey % 40) * 1e-1 AS p1_price, concat_ws('|', l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem),
m AS (SELECT r.match_id, play_ts, captured_at, p1_price, place, captured_at <= play_ts AS before FROM r LEFT JOIN c ON c.match_id = r.match_id AND captured_at BETWEEN play_ts - INTERVAL 7 DAY AND play_ts + INTERVAL 7 DAY)
SELECT match_id, CAST(max(captured_at) FILTER (WHERE before) AS DATE)::VARCHAR AS day, round(arg_max(p1_price, (captured_at, place)) FILTER (WHERE before), 6) AS p1_price, count(*) FILTER (WHERE before) AS n_before, count(*) FILTER (WHERE NOT before) AS n_after FROM m GROUP BY match_id""",
)
def stream_last_captures(spark, d):
    """Each order is played 60 days after it was made, its lines are captures: the last one before play, by a stream of both over five batches of time."""
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_orderdate") + F.expr("interval 60 days")).cast("timestamp").alias("play_ts"))
    p1 = 1.2 + (F.col("l_partkey") % 40) * 0.1
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_shipdate").cast("timestamp").alias("captured_at"), p1.alias("p1_price"), (1 / ((1.02 + F.col("l_tax")) - 1 / p1)).alias("p2_price"),
        F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey").alias("place"),
    )
    low, high = r.agg(F.unix_seconds(F.min("play_ts")), F.unix_seconds(F.max("play_ts"))).first()
    cuts = [None, *[F.timestamp_seconds(F.lit((low or 0) + ((high or 0) - (low or 0)) * k // BATCHES)) for k in range(1, BATCHES)], None]
    folder = shared_path(spark, "captures")
    within = lambda rows, t, a, b: rows.filter((F.lit(True) if a is None else F.col(t) >= a) & (F.lit(True) if b is None else F.col(t) < b))
    for a, b in zip(cuts, cuts[1:], strict=False):
        captures.run_batch(spark, folder, within(r, "play_ts", a, b), within(c, "captured_at", a, b))
    captures.close(spark, folder)
    out = captures.captured(spark, folder)
    return out.select("match_id", F.to_date("captured_at").cast("string").alias("day"), F.round("p1_price", 6).alias("p1_price"), "n_before", "n_after")


DAY_ROWS = "match_id bigint, p1_name string, p2_name string, score string, day date, page bigint"


def day_archive(spark, d):
    """day, page, html: pages of 50 results of a day in two rows each."""
    rows = contest(spark, d).select("match_id", F.to_date("ts").alias("day"), F.floor(F.col("match_id") / 50).alias("page"), "winner_id", "loser_id", F.floor("margin").cast("long").alias("m"))
    link = said('<td><a href="/match-detail/?id=', F.col("match_id"), '">info</a></td>')
    one = said('<tr class="one"><td class="t-name"><a href="#">Player ', F.col("winner_id"), '</a></td><td class="score">', F.col("m"), "</td>", link, "</tr>")
    two = said('<tr class="two"><td class="t-name"><a href="#">Player ', F.col("loser_id"), "</a></td></tr>")
    parts = rows.groupBy("day", "page").agg(F.sort_array(F.collect_list(F.struct("match_id", F.concat(one, two).alias("h")))).alias("s"))  # 50 results at most
    return parts.select("day", "page", F.array_join(F.transform("s", lambda x: x["h"]), "\n").alias("html"))


@query(
    "stream_day_ledger",
    """WITH l AS (SELECT max(CAST(ts AS DATE)) AS last FROM contest), r AS (SELECT match_id, CAST(ts AS DATE) AS day, winner_id, loser_id, CAST(floor(margin) AS BIGINT) AS m, date_diff('day', CAST(ts AS DATE), last) AS back FROM contest, l)
SELECT match_id, CAST(r.day AS VARCHAR) AS day, 'Player ' || winner_id AS p1_name, 'Player ' || loser_id AS p2_name, CAST(m AS VARCHAR) AS score, CASE WHEN back < 16 AND day(r.day) % 7 = 3 THEN -1 ELSE back // 8 END::BIGINT AS batch FROM r""",
    "contest",
)
def stream_day_ledger(spark, d):
    """Day pages read newest first, eight days a batch: a first run over the last 16 days, in which some days' pages are broken; a later one over all, which begins with those."""
    archive = shared_path(spark, "archive")
    day_archive(spark, d).write.partitionBy("day").parquet(archive)
    whole = spark.read.parquet(archive).select("day", "page", "html")
    first, last = whole.agg(F.min("day"), F.max("day")).first()
    at = lambda days: whole.filter(F.col("day").isin(days))
    failing = lambda days: at(days).withColumn("html", F.when(F.dayofmonth("day") % 7 != 3, F.col("html")))
    parse = lambda rows: pages.day_results(rows, keep=["day", "page"]).select("match_id", "p1_name", "p2_name", "score", "day", "page")
    folder = shared_path(spark, "ledger")
    ledger.backfill(spark, folder, last - timedelta(15), last, failing, parse, size=8)
    ledger.backfill(spark, folder, first, last, at, parse, size=8)
    rows = ledger.matches(spark, folder, DAY_ROWS)
    return rows.select("match_id", F.col("day").cast("string").alias("day"), "p1_name", "p2_name", "score", F.col("batch").cast("long").alias("batch"))
