"""Queries on pages, draw sheets and files: each makes its pages out of the tables, as the sources write them, and reads them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bracket
from ..session import shared_path
from ..sources import drawsheets, files, pages
from .brackets import PADDED, ROUNDS, draws
from .registry import query
from .views import contest, table


def money(cents: Column) -> Column:
    """Whole hundredths as a decimal text."""
    return F.concat_ws(".", (F.floor(cents / 100)).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0"))


def said(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def page_of(rows, key: Column, order: str, html: Column):
    """page, html: rows' texts in order, a bounded number of rows a page. Rows are dealt by page before their texts are made, so that only columns travel."""
    dealt = rows.withColumn("page", key.cast("long")).repartition("page")
    parts = dealt.select("page", F.struct(F.col(order).alias("o"), html.alias("h")).alias("s")).groupBy("page").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return parts.select("page", F.array_join(F.transform("s", lambda x: x["h"]), "\n").alias("html"))


@query(
    "source_listing",
    """SELECT o_orderkey // 50 AS page, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 + o_orderkey % 86400 AS ts, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS day, '/m/' || o_orderkey AS href,
  'Customer ' || o_custkey AS p1_name, 'Clerk ' || (o_orderkey % 97) AS p2_name, CAST(105 + o_custkey % 40 * 5 AS DOUBLE) / 100 AS p1_odds, CAST(107 + o_orderkey % 50 * 3 AS DOUBLE) / 100 AS p2_odds
FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0""",
)
def source_listing(spark, d):
    """Pages of 50 listed matches; a tenth has one price only, an eleventh one name only."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ts = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + k % 86400
    names = F.when(k % 11 == 0, said("Customer ", c)).otherwise(said("Customer ", c, "  -  Clerk ", k % 97))
    second = F.when(k % 10 == 0, "").otherwise(said("<td><b>", money(107 + k % 50 * 3), "</b></td>"))
    html = said('<tr class="m"><td><span ts="', ts, '">soon</span><a href="/m/', k, '">', names, "</a></td><td><b> ", money(105 + c % 40 * 5), " </b></td>", second, "</tr>")
    return pages.listing(page_of(table(spark, d, "orders"), F.floor(k / 50), "o_orderkey", html), keep=["page"])


BOOK_PRICES = """SELECT page, book, o1, o2, round(1 / o1 + 1 / o2, 9) AS overround FROM (SELECT l_orderkey AS page, 'Book ' || (l_suppkey % 12) AS book, CAST(120 + l_partkey % 40 * 5 AS DOUBLE) / 100 AS o1,
  CAST(130 + l_suppkey % 60 * 3 AS DOUBLE) / 100 AS o2 FROM lineitem) WHERE 1 / o1 + 1 / o2 BETWEEN 96e-2 AND 12e-1"""


def book_pages(spark, d):
    """A page an order with a heading row and a row a book."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    cell = lambda cents: said('<span class="toSort noDsp"> ', money(cents), " </span>")
    name = lambda text: said('<div class="bookName"><a class="toSort" href="#">', text, "</a></div>")
    row = said(name(F.lit("Bookmakers")), cell(F.lit(150)), cell(F.lit(250)), name(said("Book ", s % 12)), cell(120 + p % 40 * 5), cell(130 + s % 60 * 3))
    return page_of(table(spark, d, "lineitem"), F.col("l_orderkey"), "l_linenumber", row)


@query("source_book_prices", BOOK_PRICES)
def source_book_prices(spark, d):
    """Pairs with an impossible margin go."""
    return pages.book_prices(book_pages(spark, d), keep=["page"]).withColumn("overround", F.round("overround", 9))


@query("source_book_prices_udtf", BOOK_PRICES)
def source_book_prices_udtf(spark, d):
    """The same rows from a Python table function that SQL calls on the table of pages; a page is one row, so rows go where they are and nothing is set up by page."""
    spark.udtf.register("book_prices_of", pages.BookPrices)
    text = "SELECT page, book, o1, o2, round(overround, 9) AS overround FROM book_prices_of(TABLE({rows}))"
    return spark.sql(text, rows=book_pages(spark, d).select(F.col("page").cast("long").alias("page"), "html"))


@query(
    "source_fixtures",
    """SELECT o_orderkey // 20 AS page, last_value(CASE WHEN o_orderkey % 5 = 0 THEN 'Cup ' || (o_orderkey // 5) END IGNORE NULLS) OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) AS tournament,
  (o_orderkey % 24) || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS start_time, 'Customer ' || o_custkey AS p1_name, 'Clerk ' || (o_orderkey % 97) AS p2_name,
  CAST(105 + o_custkey % 40 * 5 AS DOUBLE) / 100 AS p1_odds, CAST(107 + o_orderkey % 50 * 3 AS DOUBLE) / 100 AS p2_odds FROM orders""",
)
def source_fixtures(spark, d):
    """Pages of 20 matches in two rows each, with a head row before every fifth."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    head = F.when(k % 5 == 0, said('<tr class="head flags"><td class="t-name">Cup ', F.floor(k / 5), "</td></tr>")).otherwise("")
    clock = said(k % 24, ":", F.lpad((c % 60).cast("string"), 2, "0"))
    one = said('<tr class="one"><td class="first time">', clock, '<br>live</td><td class="t-name"><a href="#">Customer ', c, "</a> (", k % 9, ')</td><td class="coursew">', money(105 + c % 40 * 5), '</td><td class="course">', money(107 + k % 50 * 3), "</td></tr>")
    two = said('<tr class="one"><td class="t-name"><a href="#">Clerk ', k % 97, "</a></td></tr>")
    return pages.fixtures(page_of(table(spark, d, "orders"), F.floor(k / 20), "o_orderkey", said(head, one, two)), keep=["page"])


@query(
    "source_day_results",
    """WITH r AS (SELECT *, o_orderkey // 20 AS page, last_value(CASE WHEN o_orderkey % 5 = 0 THEN 'Cup ' || (o_orderkey // 5) || CASE o_orderkey // 5 % 4 WHEN 0 THEN ' WTA' WHEN 1 THEN ' Challenger' WHEN 2 THEN ' Futures' ELSE '' END END IGNORE NULLS) OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) AS cup FROM orders)
SELECT page, o_orderkey AS match_id, cup AS tournament, CASE WHEN contains(cup, 'WTA') THEN 'wta' WHEN contains(cup, 'Challenger') THEN 'challenger' ELSE 'atp' END AS tour, 'Customer ' || o_custkey AS p1_name, 'Clerk ' || (o_orderkey % 97) AS p2_name, '2 ' || (o_orderkey % 2) AS score,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(105 + o_custkey % 40 * 5 AS DOUBLE) / 100 END AS p1_odds, CAST(107 + o_orderkey % 50 * 3 AS DOUBLE) / 100 AS p2_odds FROM r WHERE o_orderkey % 11 <> 0 AND NOT coalesce(contains(cup, 'Futures'), false)""",
)
def source_day_results(spark, d):
    """Pages of 20 results in two rows each under head rows; some without a link, some without a price, some of circuits that are not followed."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cup = F.floor(k / 5)
    kind = F.when(cup % 4 == 0, " WTA").when(cup % 4 == 1, " Challenger").when(cup % 4 == 2, " Futures").otherwise("")
    head = F.when(k % 5 == 0, said('<tr class="head flags"><td class="t-name">Cup ', cup, kind, "</td></tr>")).otherwise("")
    link = F.when(k % 11 == 0, "").otherwise(said('<td><a href="/match-detail/?id=', k, '">info</a></td>'))
    first = F.when(k % 7 == 0, "-").otherwise(money(105 + c % 40 * 5))
    one = said('<tr class="one"><td class="t-name"><a href="#">Customer ', c, "</a> (", k % 9, ')</td><td class="result">2</td><td class="score">2</td><td class="score">', k % 2, '</td><td class="coursew">', first, '</td><td class="course">', money(107 + k % 50 * 3), "</td>", link, "</tr>")
    two = said('<tr class="two"><td class="t-name"><a href="#">Clerk ', k % 97, "</a> (", k % 5, ")</td></tr>")
    return pages.day_results(page_of(table(spark, d, "orders"), F.floor(k / 20), "o_orderkey", said(head, one, two)), keep=["page"])


@query(
    "source_quotes",
    """WITH q AS (SELECT *, l_linenumber % 3 AS m, 'Book ' || (l_suppkey % 12) AS book, CAST(120 + (l_partkey + side) % 40 * 5 AS DOUBLE) / 100 AS price_close, CAST(125 + (l_partkey + side) % 40 * 5 AS DOUBLE) / 100 AS first,
  lpad(CAST(1 + l_suppkey % 28 AS VARCHAR), 2, '0') || '.0' || (1 + l_linenumber % 9) || '. 1' || (l_partkey % 10) AS hour, l_partkey % 2 = 0 AS hover FROM lineitem, (VALUES (0), (1)) s(side))
SELECT l_orderkey AS page, book, CASE m WHEN 0 THEN 'totals' WHEN 1 THEN 'handicap' ELSE 'h2h' END AS market, CASE m WHEN 0 THEN 20.5e0 + l_linenumber WHEN 1 THEN -0.5e0 - l_linenumber END AS line,
  CASE m WHEN 0 THEN 'games' WHEN 1 THEN 'sets' END AS line_unit, CASE WHEN m = 0 THEN CASE side WHEN 0 THEN 'over' ELSE 'under' END WHEN side = 0 THEN 'p1' ELSE 'p2' END AS side, price_close,
  CASE WHEN hover THEN hour || ':45' END AS closed_at, CASE WHEN hover THEN first END AS price_open, CASE WHEN hover THEN hour || ':05' END AS opened_at FROM q""",
)
def source_quotes(spark, d):
    """A page an order; each line has a heading (totals, handicap or match) and a book's two prices, half of them with their history."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    heading = F.when(n % 3 == 0, said("Over/Under ", 20.5 + n, " games")).when(n % 3 == 1, said("Asian Handicap ", -0.5 - n, " sets")).otherwise("Home/Away")
    hour = said(F.lpad((1 + s % 28).cast("string"), 2, "0"), ".0", 1 + n % 9, ". 1", p % 10)

    def cell(side: int) -> Column:
        close, first = money(120 + (p + side) % 40 * 5), money(125 + (p + side) % 40 * 5)
        history = said("<table><tr><td>", hour, ':45</td><td class="bold">', close, "</td></tr><tr><td>Opening odds</td></tr><tr><td>", hour, ':05</td><td class="bold">', first, "</td></tr></table>")
        return said(f'<td class="k{side + 1}"><div class="odds-in up">', close, "</div>", F.when(p % 2 == 0, history).otherwise(""), "</td>")

    html = said('<th colspan="4">', heading, '</th><tr class="one"><td><span class="t">Book ', s % 12, "</span></td>", cell(0), cell(1), "</tr>")
    return pages.quotes(page_of(table(spark, d, "lineitem"), F.col("l_orderkey"), "l_linenumber", html), keep=["page"])


@query(
    "source_draw_sheet",
    f"WITH {PADDED} SELECT draw_id, slot, player_id, 'Customer ' || player_id AS name, CASE WHEN player_id IS NOT NULL AND slot < 4 THEN CAST(slot + 1 AS VARCHAR) END AS seed, player_id IS NULL AND slot % 2 = 1 AS is_bye FROM field",
)
def source_draw_sheet(spark, d):
    """Sheets with a later round and byes: by the player who stands for one, on either side, and by the result's word.

    The feed's numbers of players are odd here, as the even number that stands for a bye may be a customer's own.
    """
    field = bracket.padded(draws(spark, d), 1 << ROUNDS)
    known = F.col("player_id").isNotNull()
    player = F.struct(F.coalesce(2 * F.col("player_id") + 1, F.lit(drawsheets.BYE)).alias("id"), F.when(known, said("Customer ", F.col("player_id"))).alias("name"), F.when(known & (F.col("slot") < 4), (F.col("slot") + 1).cast("string")).alias("seed"))
    ties = field.groupBy("draw_id", F.floor(F.col("slot") / 2).cast("int").alias("tie")).agg(*[F.max(F.when(F.col("slot") % 2 == i, player)).alias(f"s{i}") for i in (0, 1)])
    turned = F.col("draw_id") % 2 == 1
    a, b = F.when(turned, F.col("s1")).otherwise(F.col("s0")), F.when(turned, F.col("s0")).otherwise(F.col("s1"))
    word = F.when((F.col("s1.id") == drawsheets.BYE) & (F.col("draw_id") % 4 == 0), "bye")
    real = ~turned | (F.col("s0.id") == drawsheets.BYE) | (F.col("s1.id") == drawsheets.BYE)  # only a bye's sides may be turned
    first = F.struct(
        F.lit(1).alias("roundId"), (F.col("tie") + 1).alias("draw"), word.alias("result"), F.when(real, a["id"]).otherwise(F.col("s0.id")).alias("player1Id"), F.when(real, b["id"]).otherwise(F.col("s1.id")).alias("player2Id"),
        F.when(real, a).otherwise(F.col("s0")).alias("player1"), F.when(real, b).otherwise(F.col("s1")).alias("player2"),
    )
    later = F.struct(F.lit(2).alias("roundId"), F.lit(1).alias("draw"), F.lit(None).cast("string").alias("result"), F.lit(1).cast("long").alias("player1Id"), F.lit(2).cast("long").alias("player2Id"))
    sheets = ties.select("draw_id", first.alias("t")).groupBy("draw_id").agg(F.collect_list("t").alias("t"))
    both = F.concat(F.transform("t", lambda t: F.to_json(t)), F.array(F.to_json(later)))
    payload = F.concat(F.lit('{"data":{"singles":['), F.array_join(both, ","), F.lit('],"doubles":[]}}'))
    read = drawsheets.first_round(sheets.select("draw_id", payload.alias("payload")))
    return read.withColumns({"slot": F.col("slot").cast("long"), "player_id": F.expr("(player_id - 1) div 2")})


@query(
    "source_results",
    """WITH m AS (SELECT *, match_id % 7 = 0 AS cut, match_id % 5 AS g FROM contest WHERE match_id % 13 <> 0)
SELECT match_id, CAST(winner_id AS VARCHAR) AS winner_id, CAST(year(ts) AS INT) AS season, CASE match_id % 4 WHEN 0 THEN 'slam' WHEN 1 THEN 'masters' WHEN 2 THEN 'main' ELSE 'other' END AS level, CASE match_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS indoor,
  CASE WHEN cut THEN 'retired' ELSE 'completed' END AS status, CAST(CASE WHEN cut THEN 19 ELSE 15 + g END AS INT) AS games, CAST(CASE WHEN cut THEN -1 ELSE 9 - g END AS INT) AS margin, NOT cut AS usable, match_id % 6 <> 0 AS has_stats FROM m""",
    "contest",
)
def source_results(spark, d):
    """Results written as CSV files with bad dates, odd numbers and missing counts, read by the source's glob and cleaned."""
    m, path = F.col("match_id"), shared_path(spark, "results")
    score = F.when(m % 7 == 0, "6-4 3-6 RET").otherwise(said("6-", m % 5, " 6-3"))
    known = {
        "tourney_level": F.when(m % 4 == 0, "G").when(m % 4 == 1, "M").when(m % 4 == 2, "A").otherwise("Z"), "indoor": F.when(m % 3 == 0, "I").when(m % 3 == 1, "O"), "round": F.lit("F"), "match_num": m,
        "winner_id": F.col("winner_id"), "loser_id": F.col("loser_id"), "score": score, "tourney_date": F.when(m % 13 == 0, "n/a").otherwise(F.date_format("ts", "yyyyMMdd")),
        "w_svpt": F.when(m % 6 != 0, F.lit("61")).otherwise("-"), "l_svpt": F.lit("58"), "w_SvGms": F.lit("9"),
    }
    rows = contest(spark, d).select(*[known.get(c, F.lit(None)).cast("string").alias(c) for c in files.RESULTS.names])
    rows.write.option("header", True).csv(path)
    read = files.cleaned(files.results(spark, f"{path}/*.csv", first_year=0))
    return read.select(F.col("match_num").cast("long").alias("match_id"), "winner_id", "season", "level", "indoor", "status", "games", "margin", "usable", "has_stats")


@query(
    "source_mixed_headers",
    """SELECT match_id, winner_id::VARCHAR AS winner_id, CASE WHEN match_id % 3 = 0 THEN CASE WHEN match_id % 2 = 0 THEN 1 ELSE 0 END END AS indoor, match_id % 3 <> 2 AS has_stats, CASE WHEN match_id % 3 = 2 THEN 'chall.csv' WHEN match_id % 3 = 1 THEN 'b.csv' ELSE 'a.csv' END AS kind FROM contest""",
    "contest",
)
def source_mixed_headers(spark, d):
    """One glob over files of three headers: all columns; none for indoor, and in another order; no counts, and a column that nobody asks for."""
    m, path = F.col("match_id"), shared_path(spark, "headers")
    known = {"indoor": F.when(m % 2 == 0, "I").otherwise("O"), "round": F.lit("F"), "match_num": m, "winner_id": F.col("winner_id"), "loser_id": F.col("loser_id"), "score": F.lit("6-4 6-3"), "tourney_date": F.lit("20240105"), "w_svpt": F.lit("61"), "l_svpt": F.lit("58"), "w_SvGms": F.lit("9")}
    rows = contest(spark, d).select(*[known.get(c, F.lit(None)).cast("string").alias(c) for c in files.RESULTS.names])
    third = lambda k: rows.filter(F.col("match_num").cast("long") % 3 == k)
    third(0).write.option("header", True).csv(f"{path}/a")
    third(1).select(*[c for c in reversed(files.RESULTS.names) if c != "indoor"]).write.option("header", True).csv(f"{path}/b")
    third(2).drop("indoor", *files.COUNTS).withColumn("note", F.lit("x, y")).write.option("header", True).csv(f"{path}/chall")
    read = files.cleaned(files.results(spark, f"{path}/*/*.csv", first_year=0))
    kind = F.when(F.col("match_num") % 3 == 2, "chall.csv").when(F.col("match_num") % 3 == 1, "b.csv").otherwise("a.csv")
    return read.select(F.col("match_num").cast("long").alias("match_id"), "winner_id", "indoor", F.coalesce("has_stats", F.lit(False)).alias("has_stats"), kind.alias("kind"))


@query("table_reload", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def table_reload(spark, d):
    """A table that is loaded, reloaded from itself, and whose last reload fails its check: readers go on with the rows before it."""
    path, rows = shared_path(spark, "reloaded"), table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    files.replace_table(rows, path)
    files.replace_table(files.current_table(spark, path).filter("o_orderstatus <> 'P'"), path)
    try:
        files.replace_table(rows.withColumn("o_totalprice", F.lit(0.0)), path, check=lambda new: new.filter("o_totalprice <= 0").isEmpty())
    except ValueError:
        pass
    return files.current_table(spark, path)


@query(
    "source_new_files",
    """SELECT CASE WHEN page_id % 17 = 0 THEN 'ongoing-' ELSE 'p-' END || page_id AS name, page_id * 10 AS modified, coalesce(length(html), 0) AS size FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0 OR page_id % 17 = 0""",
)
def source_new_files(spark, d):
    """Files that a manifest lacks, or has in another size, and those of the running season."""
    i = F.col("page_id")
    listing = table(spark, d, "pages").select(i, said(F.when(i % 17 == 0, "ongoing-").otherwise("p-"), i).alias("name"), (i * 10).alias("modified"), F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("size"))
    manifest = listing.filter(i % 3 != 0).select("name", "modified", (F.col("size") + F.when(i % 5 == 0, 1).otherwise(0)).alias("size"))
    return files.new_files(listing.drop("page_id"), manifest)


@query("source_sql", "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice BETWEEN 50000 AND 250000 AND o_orderstatus = 'F' GROUP BY o_orderpriority")
def source_sql(spark, d):
    """A statement with named parameters over a frame; values are bound, not pasted."""
    text = "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {rows} WHERE o_totalprice BETWEEN :low AND :high AND o_orderstatus = :status GROUP BY o_orderpriority"
    return spark.sql(text, args={"low": 50000.0, "high": 250000.0, "status": "F"}, rows=table(spark, d, "orders"))


@query(
    "text_tournament",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN 'wta' WHEN 2 THEN 'challenger' ELSE 'atp' END AS tour, 'city-' || p_partkey AS slug, 'Brand B.' AS player, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 24) || ':05' END AS clock FROM part""",
)
def text_tournament(spark, d):
    """Tour and slug of a feed's tournament name, a player's name without its seed, and the time at the head of a cell."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, said("National Open - City ", k)).when(k % 4 == 1, said("City ", k, " WTA")).when(k % 4 == 2, said("City ", k, " Challenger")).otherwise(said("City  ", k, " Masters"))
    rows = table(spark, d, "part").select(k.alias("id"), name.alias("name"), F.when(k % 3 == 0, "soon").otherwise(said(" ", k % 24, ":05 Live streams")).alias("cell"))
    plain = F.regexp_replace("name", " WTA$", "")
    return rows.select("id", tx.tour_of(F.col("name")).alias("tour"), tx.tournament_slug(plain).alias("slug"), tx.without_seed(F.lit("Brand B. (5)")).alias("player"), tx.clock(F.col("cell")).alias("clock"))
