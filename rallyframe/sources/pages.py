"""Prices and fixtures out of saved pages, with built-in regular expressions.

A page is split at its row marks into an array, rows are exploded, and fields are extracted from
each row's own text, so no expression scans a whole page more than once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

PRICE = r"([0-9]+(?:\.[0-9]+)?)"


def _text(html: Column) -> Column:
    """Text without tags, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    x = F.regexp_extract(text, pattern, group)
    return F.when(x != "", x)


def _rows(pages: DataFrame, html: str, mark: str, keep: list[str]) -> DataFrame:
    parts = F.posexplode(F.split(F.col(html), mark))
    return pages.select(*keep, parts.alias("i", "row")).filter("i > 0")


def links(pages: DataFrame, html: str = "html", keep: list[str] = ["page_id"]) -> DataFrame:  # noqa: B006
    """keep, i, href, label of every link."""
    rows = _rows(pages, html, r"(?i)<a\s", keep)
    return rows.select(*keep, "i", _found("row", r'(?i)href="([^"]*)"').alias("href"), _text(F.regexp_extract("row", r"^[^>]*>(.*?)(?:</a>|$)", 1)).alias("label"))


def slugs(pages: DataFrame, prefix: str, html: str = "html") -> DataFrame:
    """slug: the distinct last parts of links whose path has the prefix, in order."""
    found = F.explode(F.regexp_extract_all(F.col(html), F.lit(rf"{prefix}([A-Za-z0-9\-]+)"), F.lit(1)))
    return pages.select(found.alias("slug")).distinct().orderBy("slug")


def listing(pages: DataFrame, html: str = "html", keep: list[str] = ["page_id"]) -> DataFrame:  # noqa: B006
    """keep, ts, day, href, p1_name, p2_name, p1_odds, p2_odds of listed matches, day in UTC; a row needs two names and two prices."""
    rows = _rows(pages, html, r"(?i)<tr[^>]*>", keep)
    names = F.transform(F.split(_text(F.regexp_extract("row", r"<a [^>]*>([^<]*)</a>", 1)), r"\s+-\s+"), lambda x: F.trim(x))
    prices = F.regexp_extract_all("row", F.lit(rf"<b>\s*{PRICE}\s*</b>"), F.lit(1))
    got = rows.select(*keep, _found("row", r'ts="(\d+)"').try_cast("long").alias("ts"), _found("row", r'href="([^"]*)"').alias("href"), names.alias("names"), prices.alias("prices"))
    got = got.filter((F.size("names") == 2) & (F.size("prices") >= 2) & F.col("ts").isNotNull() & (F.get("names", F.lit(0)) != "") & (F.get("names", F.lit(1)) != ""))
    return got.select(
        *keep, "ts", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")), "yyyyMMdd").cast("int").alias("day"), "href", F.get("names", F.lit(0)).alias("p1_name"), F.get("names", F.lit(1)).alias("p2_name"),
        F.get("prices", F.lit(0)).cast("double").alias("p1_odds"), F.get("prices", F.lit(1)).cast("double").alias("p2_odds"),
    )


def book_prices(pages: DataFrame, html: str = "html", keep: list[str] = ["page_id"]) -> DataFrame:  # noqa: B006
    """keep, book, o1, o2, overround of a match page's books; heading rows and impossible pairs are left out."""
    rows = _rows(pages, html, r'(?i)<div class="bookName">', keep)
    prices = F.regexp_extract_all("row", F.lit(rf'<span class="toSort noDsp">\s*{PRICE}\s*</span>'), F.lit(1))
    got = rows.select(*keep, F.trim(F.regexp_extract("row", r'class="toSort"[^>]*>([^<]+)</a>', 1)).alias("book"), prices.alias("p")).filter("size(p) >= 2 and book <> '' and not lower(book) like 'bookmaker%'")
    out = got.select(*keep, "book", F.get("p", F.lit(0)).cast("double").alias("o1"), F.get("p", F.lit(1)).cast("double").alias("o2"))
    return out.withColumn("overround", F.try_divide(F.lit(1.0), "o1") + F.try_divide(F.lit(1.0), "o2")).filter(F.col("overround").between(0.96, 1.20))


def fixtures(pages: DataFrame, html: str = "html", keep: list[str] = ["page_id"]) -> DataFrame:  # noqa: B006
    """keep, tournament, start_time, p1_name, p2_name, p1_odds, p2_odds of a page of matches in two rows each.

    A head row names the tournament of the rows below; a match is a row with a time and the row after it.
    """
    from pyspark.sql import Window

    rows = _rows(pages, html, r"(?i)<tr(?=[\s>])", keep)
    w = Window.partitionBy(*keep).orderBy("i")
    head = F.regexp_like("row", F.lit(r'^ class="[^"]*\bhead\b'))
    name = F.trim(F.regexp_replace(_text(F.regexp_extract("row", r'<td class="t-name">(.*?)</td>', 1)), r"\s*\(\d+\)$", ""))
    prices = F.regexp_extract_all("row", F.lit(rf'<td class="(?:course|coursew)">\s*{PRICE}'), F.lit(1))
    got = rows.select(*keep, "i", head.alias("head"), name.alias("name"), _found("row", r'<td class="[^"]*\btime\b[^"]*">\s*(\d{1,2}:\d\d)').alias("start_time"), prices.alias("p"))
    got = got.withColumn("tournament", F.last(F.when(F.col("head"), F.col("name")), ignorenulls=True).over(w)).withColumn("p2_name", F.lead("name").over(w))
    got = got.filter("not head and start_time is not null")
    return got.select(*keep, "tournament", "start_time", F.col("name").alias("p1_name"), "p2_name", F.get("p", F.lit(0)).cast("double").alias("p1_odds"), F.get("p", F.lit(1)).cast("double").alias("p2_odds"))


# Words of tournaments that are not followed.
SKIPPED = ("itf", "futures", "utr", "exhibition")


def day_results(pages: DataFrame, html: str = "html", keep: list[str] = ["page_id"]) -> DataFrame:  # noqa: B006
    """keep, match_id, tournament, tour, p1_name, p2_name, score, p1_odds, p2_odds of a page of a day's matches in two rows each.

    A head row names the tournament of the rows below; a match is a row with a link to its page and the row after it, and needs both
    names. Tournaments with a word of SKIPPED are left out. A price that is no number is null.
    """
    from pyspark.sql import Window

    from ..functions import text as tx

    rows = _rows(pages, html, r"(?i)<tr(?=[\s>])", keep)
    w = Window.partitionBy(*keep).orderBy("i")
    head = F.regexp_like("row", F.lit(r'^ class="[^"]*\bhead\b'))
    label = _text(F.regexp_extract("row", r'<td class="t-name">(.*?)</td>', 1))
    cells = lambda names: F.regexp_extract_all("row", F.lit(rf'<td class="(?:[^"]* )?(?:{names})(?: [^"]*)?">([^<]*)'), F.lit(1))
    got = rows.select(
        *keep, "i", head.alias("head"), label.alias("label"), tx.without_seed(label).alias("name"), _found("row", r'href="[^"]*/match-detail/\?id=(\d+)').try_cast("long").alias("match_id"), cells("coursew?").alias("p"), F.trim(F.array_join(cells("score"), " ")).alias("score")
    )
    got = got.withColumn("tournament", F.last(F.when(F.col("head"), F.col("label")), ignorenulls=True).over(w)).withColumn("p2_name", F.lead("name").over(w))
    got = got.filter("not head and match_id is not null and name <> '' and p2_name <> ''").filter(~F.regexp_like(F.lower(F.coalesce("tournament", F.lit(""))), F.lit("|".join(SKIPPED))))
    price = lambda i: F.trim(F.get("p", F.lit(i))).try_cast("double")
    return got.select(*keep, "match_id", "tournament", tx.tour_of(F.col("tournament")).alias("tour"), F.col("name").alias("p1_name"), "p2_name", "score", price(0).alias("p1_odds"), price(1).alias("p2_odds"))


#: Words of a line's heading and the market and unit that they mean.
MARKETS = {"Over/Under": "totals", "Asian Handicap": "handicap", "Correct score": "correct_score", "Home/Away": "h2h"}
SIDES = {"totals": ("over", "under")}


def quotes(pages: DataFrame, html: str = "html", keep: list[str] = ["page_id"]) -> DataFrame:  # noqa: B006
    """keep, book, market, line, line_unit, side, price_close, closed_at, price_open, opened_at of a match page.

    A heading names market, line and unit of the book rows below; a price with a hover table has its history, the closing price first
    and the opening price after its title; one without has a close alone.
    """
    # Rows are left out by generators of nothing: a filter would be moved down and run the expressions of the columns it reads once more.
    parts = _rows(pages, html, r'(?i)<th colspan="\d+">', keep).select(*keep, "row", F.trim(F.regexp_extract("row", r"^([^<]*)</th>", 1)).alias("heading"))
    market = F.coalesce(*[F.when(F.startswith("heading", F.lit(k)), v) for k, v in MARKETS.items()])
    head = parts.select(*keep, "row", market.alias("market"), _found("heading", r"([-+]?\d+(?:\.\d+)?)").cast("double").alias("line"), _found("heading", r"\b(sets|games)\b").alias("line_unit"))
    head = head.select(*keep, "market", "line", "line_unit", F.explode(F.when(F.col("market").isNotNull(), F.split("row", r'<tr class="'))).alias("row"))
    cells = head.withColumn("book", F.trim(F.regexp_extract("row", r'<span class="t">([^<]+)</span>', 1)))
    cells = cells.select(*keep, "book", "market", "line", "line_unit", F.posexplode(F.when(F.col("book") != "", F.slice(F.split("row", r'<td class="k[12]">'), 2, 2))).alias("k", "cell"))
    at, price = r"(\d\d\.\d\d\. \d\d:\d\d)</td><td class=\"bold\">", PRICE
    title, market = "Opening odds", F.col("market")
    closing, opening = F.substring_index("cell", title, 1), F.when(F.contains("cell", F.lit(title)), F.substring_index(F.substring_index("cell", title, 2), title, -1))
    side = F.when(market == "totals", F.when(F.col("k") == 0, "over").otherwise("under")).when(F.col("k") == 0, "p1").otherwise("p2")
    read = cells.select(*keep, "book", "market", "line", "line_unit", side.alias("side"), _found("cell", rf'class="odds-in[^"]*">\s*{price}').cast("double").alias("price_close"), closing.alias("closing"), opening.alias("opening"))
    priced = read.select(*read.columns[:-2], F.explode(F.when(F.col("price_close").isNotNull(), F.array(F.struct("closing", "opening")))).alias("h"))
    found = {"closed_at": _found("h.closing", at), "price_open": _found("h.opening", at + price, 2).cast("double"), "opened_at": _found("h.opening", at)}
    return priced.select(*priced.columns[:-1], *[c.alias(n) for n, c in found.items()])


BOOK = re.compile(r'(?i)<div class="bookName">')
LINK = re.compile(r'class="toSort"[^>]*>([^<]+)</a>')
CELL = re.compile(rf'<span class="toSort noDsp">\s*{PRICE}\s*</span>')


PRICES = pa.schema([("page", pa.int64()), ("i", pa.int64()), ("book", pa.string()), ("o1", pa.float64()), ("o2", pa.float64()), ("overround", pa.float64())])


def _books_of(html: str | None) -> Iterator[tuple]:
    for i, part in enumerate(BOOK.split(html or "")[1:], 1):
        name, prices = LINK.search(part), CELL.findall(part)
        book = name[1].strip() if name else ""
        if len(prices) < 2 or not book or book.lower().startswith("bookmaker"):
            continue
        o1, o2 = float(prices[0]), float(prices[1])
        over = 1 / o1 + 1 / o2 if o1 and o2 else 0.0
        if 0.96 <= over <= 1.20:
            yield i, book, o1, o2, over


@arrow_udtf(returnType="page bigint, i bigint, book string, o1 double, o2 double, overround double")
class BookPrices:
    """book_prices as a table function: ``SELECT * FROM book_prices_of(TABLE(pages))`` over rows (page, html).

    A row of a page is read by itself, so no PARTITION BY is needed, which would set up and sort for each page; several rows of one page are read as they come, a batch at a time. A null or broken page has no rows.
    """

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        found = [(page, *x) for page, html in zip(batch["page"].to_pylist(), batch["html"].to_pylist(), strict=True) for x in _books_of(html)]
        yield pa.Table.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(PRICES)], schema=PRICES)
