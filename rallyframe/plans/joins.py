"""Queries on joins, matching and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from .brackets import DRAWS, chance, draws
from .registry import query
from .views import contest, forecast, player_match, price, table


@query(
    "join_dimension",
    "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def join_dimension(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query(
    "join_two_roles",
    """SELECT match_id, w.c_name AS winner_name, l.c_name AS loser_name FROM contest JOIN customer w ON w.c_custkey = winner_id LEFT JOIN customer l ON l.c_custkey = loser_id""",
    "contest",
)
def join_two_roles(spark, d):
    names = table(spark, d, "customer")
    w = names.select(F.col("c_custkey").alias("winner_id"), F.col("c_name").alias("winner_name"))
    lo = names.select(F.col("c_custkey").alias("loser_id"), F.col("c_name").alias("loser_name"))
    return contest(spark, d).join(w, "winner_id").join(lo, "loser_id", "left").select("match_id", "winner_name", "loser_name")


@query(
    "join_left_prices",
    """WITH b AS (SELECT match_id, max(p1_price) AS p1, max(p2_price) AS p2 FROM price WHERE book = 3 GROUP BY match_id)
SELECT season, count(*) AS n, count(p1) AS priced, round(avg(p1), 6) AS avg_p1 FROM forecast LEFT JOIN b USING (match_id) GROUP BY season""",
    "forecast price",
)
def join_left_prices(spark, d):
    book = price(spark, d).filter("book = 3").groupBy("match_id").agg(F.max("p1_price").alias("p1"))
    return forecast(spark, d).join(book, "match_id", "left").groupBy("season").agg(F.count("*").alias("n"), F.count("p1").alias("priced"), F.round(F.avg("p1"), 6).alias("avg_p1"))


@query(
    "join_multi_key",
    """WITH k AS (SELECT l_orderkey, l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS season, l_quantity FROM lineitem), s AS (SELECT season, l_suppkey, sum(l_quantity) AS q FROM k GROUP BY ALL)
SELECT k.season, k.l_suppkey, count(*) AS n, CAST(max(q) AS DOUBLE) AS q FROM k JOIN s USING (season, l_suppkey) GROUP BY ALL""",
)
def join_multi_key(spark, d):
    k = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("long").alias("season"), "l_quantity")
    s = k.groupBy("season", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return k.join(s, ["season", "l_suppkey"]).groupBy("season", "l_suppkey").agg(F.count("*").alias("n"), F.max("q").cast("double").alias("q"))


@query(
    "join_unordered_pair",
    """WITH p AS (SELECT least(winner_id, loser_id) AS pair_lo, greatest(winner_id, loser_id) AS pair_hi, count(*) AS n, count(*) FILTER (WHERE winner_id < loser_id) AS lo_wins FROM contest GROUP BY ALL)
SELECT c.match_id, n, lo_wins FROM contest c JOIN p ON pair_lo = least(winner_id, loser_id) AND pair_hi = greatest(winner_id, loser_id)""",
    "contest",
)
def join_unordered_pair(spark, d):
    rows = contest(spark, d).select("match_id", "winner_id", "loser_id", *rel.pair_key("winner_id", "loser_id"))
    pairs = rows.groupBy("pair_lo", "pair_hi").agg(F.count("*").alias("n"), F.count_if(F.col("winner_id") < F.col("loser_id")).alias("lo_wins"))
    return rows.join(pairs, ["pair_lo", "pair_hi"]).select("match_id", "n", "lo_wins")


BAND = """WITH o AS (SELECT o_custkey % 500 AS k, o_orderkey AS left_id, CAST(o_orderdate AS DATE) AS a FROM orders), l AS (SELECT l_orderkey * 10 + l_linenumber AS right_id, l_suppkey % 500 AS k, CAST(l_shipdate AS DATE) AS b FROM lineitem),
j AS (SELECT o.k, left_id, right_id, date_diff('day', a, b) AS gap FROM o JOIN l USING (k) WHERE date_diff('day', a, b) BETWEEN -7 AND 7),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY abs(gap), right_id) AS p FROM j) WHERE p = 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY abs(gap), left_id) AS q FROM f) WHERE q = 1) SELECT k, left_id, right_id, gap FROM s"""


@query("join_banded_nearest", BAND)
def join_banded_nearest(spark, d):
    left = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("k"), F.col("o_orderkey").alias("left_id"), F.to_date("o_orderdate").alias("a"))
    right = table(spark, d, "lineitem").select((F.col("l_suppkey") % 500).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("right_id"), F.to_date("l_shipdate").alias("b"))
    return rel.banded_nearest(left, right, ["k"], "a", "b", 7, "left_id", "right_id")


@query(
    "join_as_of",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders),
h AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS rank_points FROM orders GROUP BY ALL),
b AS (SELECT o.o_orderkey, max(h.o_orderdate) AS at FROM o JOIN h ON h.o_custkey = o.o_custkey AND h.o_orderdate < o.o_orderdate GROUP BY ALL)
SELECT o.o_orderkey, h.rank_points FROM o LEFT JOIN b USING (o_orderkey) LEFT JOIN h ON h.o_custkey = o.o_custkey AND h.o_orderdate = b.at""",
)
def join_as_of(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("rank_points"))
    return rel.as_of(orders.drop("rank_points"), orders.select("o_custkey", "o_orderdate", "rank_points"), "o_custkey", "o_orderdate", "o_orderdate", ["rank_points"]).select("o_orderkey", "rank_points")


@query(
    "join_last_age",
    """WITH u AS (SELECT winner_id AS player_id, match_id, ts, margin FROM contest UNION ALL SELECT loser_id, match_id, ts, margin FROM contest)
SELECT player_id, arg_max(margin, match_id) AS last_margin, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS BIGINT) AS days_since FROM u GROUP BY player_id""",
    "contest",
)
def join_last_age(spark, d):
    rows = player_match(contest(spark, d))
    return rows.groupBy("player_id").agg(F.max_by("margin", "match_id").alias("last_margin"), F.datediff(F.lit("2024-02-01").cast("date"), F.to_date(F.max("ts"))).cast("long").alias("days_since"))


@query(
    "join_semi_anti",
    """SELECT 'priced' AS kind, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'unpriced', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""",
)
def join_semi_anti(spark, d):
    orders, wanted = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    semi = orders.join(wanted, "o_orderkey", "left_semi").agg(F.count("*").alias("n")).select(F.lit("priced").alias("kind"), "n")
    return semi.unionByName(orders.join(wanted, "o_orderkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unpriced").alias("kind"), "n"))


JACCARD = """WITH s AS (SELECT DISTINCT l_orderkey AS e, l_partkey * 1000 + l_suppkey AS i FROM lineitem), n AS (SELECT e, count(*) AS n FROM s GROUP BY e),
x AS (SELECT a.e AS a, b.e AS b, count(*) AS shared FROM s a JOIN s b ON a.i = b.i AND a.e < b.e GROUP BY ALL)
SELECT x.a, x.b, shared, round(shared / (p.n + q.n - shared), 6) AS jaccard FROM x JOIN n p ON p.e = x.a JOIN n q ON q.e = x.b WHERE shared / (p.n + q.n - shared) >= 0.5"""


@query("join_jaccard", JACCARD)
def join_jaccard(spark, d):
    sets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("e"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("i"))
    return rel.set_similarity(sets, "e", "i", 0.5).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "join_best_in_band",
    """WITH i AS (SELECT DISTINCT o_orderkey AS id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT id, count(*) AS n FROM i GROUP BY id),
p AS (SELECT a.id AS left_id, b.id AS right_id, abs(a.day - b.day) AS gap, count(*) AS c FROM i a JOIN i b ON a.item = b.item AND a.id % 2 = 1 AND b.id % 2 = 0 AND abs(a.day - b.day) <= 10 GROUP BY ALL),
s AS (SELECT left_id, right_id, gap, c / (x.n + y.n - c) AS jaccard FROM p JOIN n x ON x.id = left_id JOIN n y ON y.id = right_id)
SELECT left_id, right_id, round(jaccard, 6) AS jaccard, gap FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY jaccard DESC, gap, right_id) AS k FROM s WHERE jaccard >= 0.2) WHERE k = 1""",
)
def join_best_in_band(spark, d):
    """For each odd order the even one with the most similar parts within ten days."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("items"))
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day")).join(items, "id")
    return rel.best_in_band(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "join_common_sample",
    """WITH b AS (SELECT DISTINCT ln, book FROM price), n AS (SELECT count(DISTINCT ln) AS n FROM price), c AS (SELECT book FROM b GROUP BY book HAVING count(*) = (SELECT n FROM n))
SELECT book, count(*) AS quotes, round(avg(p1_price), 6) AS p1 FROM price WHERE book IN (SELECT book FROM c) GROUP BY book""",
    "price",
)
def join_common_sample(spark, d):
    return rel.in_every(price(spark, d), "ln", "book").groupBy("book").agg(F.count("*").alias("quotes"), F.round(F.avg("p1_price"), 6).alias("p1"))


@query(
    "join_lookup_fallback",
    """WITH e AS (SELECT user_id, min(event_type) AS v FROM events WHERE value > 90 GROUP BY user_id), s AS (SELECT user_id, min(event_type) AS v FROM events GROUP BY user_id)
SELECT c_custkey, coalesce(e.v, s.v) AS kind FROM customer LEFT JOIN e ON e.user_id = c_custkey LEFT JOIN s ON s.user_id = c_custkey % 100""",
)
def join_lookup_fallback(spark, d):
    events = table(spark, d, "events")
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100).alias("near"))
    return rel.lookup(rows, "kind", ("c_custkey", events.filter("value > 90"), "user_id", "event_type"), ("near", events, "user_id", "event_type")).select("c_custkey", "kind")


#: What a feed makes of a part's name, and who the players are: words of colours, so that names are shared by many.
FEED_NAME = """CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(split_part(p_name, ' ', -1), ' ', left(p_name, 1), '.') WHEN 3 THEN concat(p_name, ' Xylo') WHEN 4 THEN concat('Q', p_name) ELSE CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END END"""
KEYED = r"""len(l) AS n, CASE WHEN len(l) = 0 THEN coalesce(w[1], '') WHEN len(l) = 1 AND len(i) = 0 THEN l[1] ELSE l[-1] || '|' || coalesce(i[1], left(l[1], 1)) END AS skey
  FROM (SELECT *, list_filter(w, lambda x: length(x) = 1) AS i, list_filter(w, lambda x: length(x) > 1) AS l FROM (SELECT *, list_filter(string_split(plain, ' '), lambda x: x <> '') AS w FROM {0}))"""
PLAIN = r"""trim(regexp_replace(translate(lower(strip_accents(coalesce({0}, ''))), '-.' || chr(39), '  '), '\s+', ' ', 'g'))"""


@query(
    "join_names_resolved",
    f"""WITH p0 AS (SELECT p_partkey AS player_id, p_size AS seen, {PLAIN.format("p_name")} AS plain FROM part), pk AS (SELECT player_id, seen, plain, {KEYED.format("p0")}),
x AS (SELECT 'n' || plain AS key, player_id, seen FROM pk WHERE plain <> '' UNION ALL SELECT 's' || skey, player_id, seen FROM pk WHERE skey <> ''), ix AS (SELECT key, arg_max(player_id, (seen, -player_id)) AS player_id FROM x GROUP BY key),
a0 AS (SELECT p_partkey AS id, name, {PLAIN.format("name")} AS plain FROM (SELECT p_partkey, {FEED_NAME} AS name FROM part)), ak AS (SELECT id, name, plain, l, {KEYED.format("a0")}),
r AS (SELECT id, 0 AS level, 'n' || plain AS key FROM ak UNION ALL SELECT id, 1, 's' || skey FROM ak UNION ALL SELECT id, k, 's' || l[k] || '|' || left(l[1], 1) FROM (SELECT id, l, unnest(range(2, n + 1)) AS k FROM ak WHERE n > 2)),
b AS (SELECT id, min(level) AS level, arg_min(player_id, level) AS player_id FROM r JOIN ix USING (key) WHERE length(key) > 1 GROUP BY id)
SELECT ak.id, name, player_id, CAST(level AS INT) AS level FROM ak LEFT JOIN b USING (id)""",
)
def join_names_resolved(spark, d):
    """Feed names to players: whole names, then surname and initial, then any later word as the surname; of players with one key the last seen."""
    parts = table(spark, d, "part")
    players = parts.select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.col("p_size").alias("last_seen"))
    feed = parts.select(F.col("p_partkey").alias("id"), F.expr(FEED_NAME).alias("name"))
    return rel.resolved(feed, players).select("id", "name", "player_id", "level")


@query(
    "join_all_pairs",
    f"""WITH {DRAWS} SELECT a.draw_id, a.player_id AS i, b.player_id AS j, round(1 / (1 + exp((b.strength - a.strength) / 3000)), 6) AS p FROM draws a JOIN draws b ON a.draw_id = b.draw_id AND a.slot < b.slot""",
)
def join_all_pairs(spark, d):
    """Win chances of all pairs inside every draw; a draw's field has sixteen places, so pairs grow with the draws alone."""
    field = draws(spark, d)
    a = field.select("draw_id", F.col("slot").alias("_a"), F.col("player_id").alias("i"), F.col("strength").alias("ri"))
    b = field.select("draw_id", F.col("slot").alias("_b"), F.col("player_id").alias("j"), F.col("strength").alias("rj"))
    return a.join(b, "draw_id").filter("_a < _b").select("draw_id", "i", "j", F.round(chance(F.col("ri"), F.col("rj")), 6).alias("p"))


@query(
    "table_upsert",
    """WITH u AS (SELECT o_orderkey, o_totalprice, 0 AS n FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, -o_totalprice, 1 FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC) AS p FROM u) WHERE p = 1""",
)
def table_upsert(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rel.upsert(orders.filter("o_orderkey % 3 <> 0"), orders.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", -F.col("o_totalprice")), ["o_orderkey"], F.lit(0))


@query(
    "table_insert_new",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0""",
)
def table_insert_new(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rel.insert_new(orders.filter("o_orderkey % 3 = 0"), orders.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", -F.col("o_totalprice")), ["o_orderkey"])


@query(
    "table_update",
    """WITH m AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS d FROM lineitem WHERE l_quantity > 40 GROUP BY ALL)
SELECT o_orderkey, CAST(coalesce(m.d, o_orderdate) AS VARCHAR)[1:10] AS day FROM orders LEFT JOIN m USING (o_orderkey)""",
)
def table_update(spark, d):
    fresh = table(spark, d, "lineitem").filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("o_orderdate"))
    out = rel.update_from(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), fresh, ["o_orderkey"], ["o_orderdate"])
    return out.select("o_orderkey", F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day"))


@query(
    "table_replace_scope",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE left(o_orderpriority, 1) <> '1' UNION ALL SELECT o_orderkey, o_orderpriority, 0e0 FROM orders WHERE left(o_orderpriority, 1) = '1' AND o_orderkey % 2 = 0""",
)
def table_replace_scope(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    own = orders.filter("left(o_orderpriority, 1) = '1' and o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0))
    return rel.replace_scope(orders, own, "o_orderpriority")


@query(
    "table_dedupe_null_keys",
    """SELECT k, line, count(*) AS n, min(l_extendedprice) AS p FROM (SELECT l_orderkey AS k, CASE WHEN l_linenumber > 3 THEN NULL ELSE l_linenumber END AS line, l_extendedprice FROM lineitem) GROUP BY ALL""",
)
def table_dedupe_null_keys(spark, d):
    """Rows with equal keys become one, a null in a key being equal to a null."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")).alias("line"), "l_extendedprice")
    return rows.groupBy("k", "line").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("p"))


@query(
    "table_profile",
    """SELECT o_custkey, mode(o_orderpriority ORDER BY o_orderpriority) AS usual, median(o_totalprice) AS mid, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n FROM
  (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_custkey, o_orderpriority) GROUP BY o_custkey""".replace(
        "mode(o_orderpriority ORDER BY o_orderpriority)", "(SELECT p FROM (SELECT o_orderpriority AS p, count(*) AS c FROM orders i WHERE i.o_custkey = x.o_custkey GROUP BY ALL) ORDER BY c DESC, p LIMIT 1)"
    ).replace("(SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_custkey, o_orderpriority)", "orders x"),
)
def table_profile(spark, d):
    """One row a player: usual value (lowest of ties), median, extent and count."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.mode("o_orderpriority", True).alias("usual"), F.median("o_totalprice").alias("mid"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count("*").alias("n")
    )


@query(
    "table_pivot",
    """SELECT season, count(*) FILTER (WHERE surface = '1-URGENT') AS urgent, count(*) FILTER (WHERE surface = '2-HIGH') AS high, count(*) FILTER (WHERE surface = '5-LOW') AS low FROM forecast GROUP BY season""",
    "forecast",
)
def table_pivot(spark, d):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    wide = forecast(spark, d).groupBy("season").pivot("surface", list(names)).agg(F.count("match_id"))
    return wide.select("season", *[F.coalesce(k, F.lit(0)).alias(v) for k, v in names.items()])


@query(
    "table_unpivot",
    """SELECT match_id, side, price FROM (SELECT match_id, 'p1' AS side, max(p1_price) AS price FROM price GROUP BY match_id UNION ALL SELECT match_id, 'p2', max(p2_price) FROM price GROUP BY match_id)""",
    "price",
)
def table_unpivot(spark, d):
    wide = price(spark, d).groupBy("match_id").agg(F.max("p1_price").alias("p1"), F.max("p2_price").alias("p2"))
    return wide.unpivot("match_id", ["p1", "p2"], "side", "price")


@query(
    "table_conflicting_names",
    """SELECT l_partkey, count(DISTINCT l_returnflag) AS names, max(CASE WHEN l_linestatus = 'F' THEN l_returnflag END) AS f, max(CASE WHEN l_linestatus = 'O' THEN l_returnflag END) AS o
FROM lineitem GROUP BY l_partkey HAVING max(CASE WHEN l_linestatus = 'F' THEN l_returnflag END) <> max(CASE WHEN l_linestatus = 'O' THEN l_returnflag END)""",
)
def table_conflicting_names(spark, d):
    """Keys that two families of rows name differently."""
    wide = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.countDistinct("l_returnflag").alias("names"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_returnflag"))).alias("f"), F.max(F.when(F.col("l_linestatus") == "O", F.col("l_returnflag"))).alias("o")
    )
    return wide.filter("f <> o")


@query(
    "table_weighted_ratio",
    "SELECT surface, round(sum(margin) / sum(total), 6) AS share, count(*) AS n FROM contest WHERE NOT retired GROUP BY surface",
    "contest",
)
def table_weighted_ratio(spark, d):
    return contest(spark, d).filter("not retired").groupBy("surface").agg(F.round(F.sum("margin") / F.sum("total"), 6).alias("share"), F.count("*").alias("n"))


@query(
    "table_set_operations",
    """SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)
UNION ALL SELECT 'orders only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events) UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events)""",
)
def table_set_operations(spark, d):
    a, b = table(spark, d, "orders").select("o_custkey"), table(spark, d, "events").select("user_id")
    parts = {"both": a.intersect(b), "orders only": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for kind, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out
