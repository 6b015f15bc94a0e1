"""Queries of paper accounts, price scans, demonstration news and states of feeds and caches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import text
from quantloom.operators import account, learning
from quantloom.sources import demo, tables

from . import views
from .catalog import NEWS, _news, query
from .feeds import HISTORY, history
from .technical import ROLLING, top_n_by_score

CASH = 300_000.0
# Orders one after another: three lists hold an account's quantity, average price and invested amount of each of its symbols.
PAPER = f"""names AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT p_brand AS symbol FROM part)), size AS (SELECT count(*) AS m FROM names),
    o0 AS (SELECT o_custkey AS account, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, floor(l_extendedprice / l_quantity * 100 + .5::DOUBLE) / 100 AS price, CASE WHEN l_linenumber <> 1 THEN l_tax * 100 END AS told,
        row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
    o AS (SELECT o0.*, k, quantity * price AS gross, coalesce(told, quantity * price * (.1::DOUBLE / 100)) AS fees FROM o0 JOIN names USING (symbol)),
    book AS (SELECT account, 0::BIGINT AS n, 0::BIGINT AS k, TRUE AS good, {CASH}::DOUBLE AS cash, 0::DOUBLE AS realized, list_resize([0::DOUBLE], m, 0::DOUBLE) AS q, list_resize([0::DOUBLE], m, 0::DOUBLE) AS a, list_resize([0::DOUBLE], m, 0::DOUBLE) AS i FROM (SELECT DISTINCT account FROM o), size
        UNION ALL SELECT account, n, k, good, CASE WHEN NOT good THEN cash WHEN side = 'BUY' THEN cash - (gross + fees) ELSE cash + (gross - fees) END, CASE WHEN good AND side = 'SELL' THEN (price - a[k]) * quantity - fees ELSE 0 END,
            list_concat(list_concat(q[1:k-1], [q2]), q[k+1:]), list_concat(list_concat(a[1:k-1], [CASE WHEN good AND side = 'BUY' THEN i2 / q2 ELSE a[k] END]), a[k+1:]), list_concat(list_concat(i[1:k-1], [i2]), i[k+1:])
        FROM (SELECT *, CASE WHEN NOT good THEN q[k] WHEN side = 'BUY' THEN q[k] + quantity ELSE q[k] - quantity END AS q2, CASE WHEN NOT good THEN i[k] WHEN side = 'BUY' THEN i[k] + gross + fees WHEN q[k] - quantity > 0 THEN greatest(0, i[k] - a[k] * quantity) ELSE 0 END AS i2
            FROM (SELECT b.account, o.n, o.k, o.side, o.quantity, o.price, o.gross, o.fees, b.cash, b.q, b.a, b.i, CASE WHEN o.side = 'BUY' THEN b.cash >= o.gross + o.fees ELSE b.q[o.k] >= o.quantity END AS good FROM book b JOIN o ON o.account = b.account AND o.n = b.n + 1))),
    done AS (SELECT b.account, b.n, o.symbol, o.side, o.quantity, b.good, b.cash, b.q[b.k] AS held, b.a[b.k] AS average_price, b.i[b.k] AS invested, b.realized FROM book b JOIN o USING (account, n))"""


def executed(spark, sf):
    """The order log as paper orders of the customers that placed them; a first line's fees are left to the account."""
    t = {n: views.table(spark, sf, n) for n in ("lineitem", "part", "orders")}
    rows = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(
        F.col("o_custkey").alias("account"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.col("p_brand").alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("quantity"), views.cents(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"), F.when(F.col("l_linenumber") != 1, F.col("l_tax") * 100).alias("fees"),
    )
    return account.execute(rows, CASH)


def _milli(*columns: str) -> str:
    return ", ".join(f"floor({c} * 1000 + .5::DOUBLE) / 1000 AS {c}" for c in columns)


def _gain(x: str) -> str:
    return f"floor({x} / 10000 + .5::DOUBLE) / 100"


MICRO = "floor(realized * 1e6::DOUBLE + .5::DOUBLE)::BIGINT"
milli = lambda c: views.cents(F.col(c), 3).alias(c)


@query("paper_orders", f"WITH RECURSIVE {PAPER} SELECT account, n, symbol, side, CASE WHEN good THEN 'SIMULATED' WHEN side = 'BUY' THEN 'NO_CASH' ELSE 'NO_HOLDING' END AS status, held, {_milli('cash', 'average_price', 'invested', 'realized')} FROM done")
def paper_orders(spark, sf):
    place = F.row_number().over(W.partitionBy("account").orderBy("seq")).cast("long").alias("n")
    return executed(spark, sf).select("account", place, "symbol", "side", "status", "held", *map(milli, ("cash", "average_price", "invested", "realized")))


@query("paper_positions", f"WITH RECURSIVE {PAPER}, p AS (SELECT account, symbol, arg_max(held, n) AS quantity, arg_max(average_price, n) AS average_price, arg_max(invested, n) AS invested_amount, sum({MICRO}) AS m FROM done WHERE good GROUP BY account, symbol) SELECT account, symbol, quantity, {_milli('average_price', 'invested_amount')}, {_gain('m')} AS realized FROM p WHERE quantity > 0")
def paper_positions(spark, sf):
    return account.holdings(executed(spark, sf)).select("account", "symbol", "quantity", milli("average_price"), milli("invested_amount"), "realized")


@query("paper_snapshots", f"""WITH RECURSIVE {PAPER}, s AS (SELECT account, n, cash, sum({MICRO}) OVER (PARTITION BY account ORDER BY n) AS m, row_number() OVER (PARTITION BY account ORDER BY n DESC) AS back FROM done WHERE good)
    SELECT account, (row_number() OVER (PARTITION BY account ORDER BY n))::INT AS place, {_milli('cash')}, {_gain('m')} AS total_realized FROM s WHERE back <= 20""")
def paper_snapshots(spark, sf):
    return account.snapshots(executed(spark, sf)).select("account", "place", milli("cash"), "total_realized")


@query("price_scan", f"WITH {HISTORY} SELECT symbol, date, is_real, close, volume FROM hist WHERE upper(symbol) IN ('BRAND#11', 'BRAND#23') AND date <= DATE '1996-12-31'")
def price_scan(spark, sf):
    """Bars of named symbols up to a date."""
    return tables.scan_prices(history(spark, sf), ["brand#11", " Brand#23"], "1996-12-31").select("symbol", "date", "is_real", "close", "volume")


@query("price_rows_by_date", f"WITH {HISTORY} SELECT symbol, date, close, is_real FROM hist WHERE close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY is_real) = 1")
def price_rows_by_date(spark, sf):
    """One bar a symbol and date for training."""
    return tables.one_a_date(history(spark, sf)).select("symbol", "date", "close", "is_real")


@query("refresh_summary", f"""WITH {HISTORY}, s AS (SELECT symbol, count(*) FILTER (WHERE is_real) AS fresh FROM hist GROUP BY symbol), u AS (SELECT count(*) FILTER (WHERE o.date IS NULL) AS inserted, count(*) FILTER (WHERE o.date IS NOT NULL) AS updated FROM hist n LEFT JOIN (SELECT symbol, date FROM hist WHERE NOT is_real) o USING (symbol, date) WHERE n.is_real)
    SELECT count(*) AS requested, count_if(fresh > 0)::BIGINT AS updated, count_if(fresh = 0)::BIGINT AS fallback, (SELECT inserted FROM u) AS rows_inserted, (SELECT updated FROM u) AS rows_updated FROM s""")
def refresh_summary(spark, sf):
    rows = history(spark, sf)
    new = rows.where("is_real").select("symbol", "date", "close", "volume", F.lit(1).alias("seq"))
    return tables.refresh_summary(rows.select("symbol").distinct(), tables.upsert_prices(rows.where("NOT is_real"), new))


@query("cache_stats", """WITH c AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'soon' WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS expires_at FROM events), v AS (SELECT count(*) AS n, count_if(try_cast(expires_at AS TIMESTAMP) > TIMESTAMP '2024-01-10 00:00:00')::BIGINT AS good FROM c)
    SELECT n AS entries, good AS valid, n - good AS expired FROM v""")
def cache_stats(spark, sf):
    told = F.when(F.col("event_id") % 7 == 0, "soon").when(F.col("event_id") % 11 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return tables.cache_stats(views.table(spark, sf, "events").select(told.alias("expires_at")), "2024-01-10 00:00:00")


@query("market_sentiment", f"""WITH {NEWS}, m AS (SELECT score, label, impact FROM scored WHERE item_id % 9 = 0 OR published_at >= DATE '2000-06-01' - 60)
    SELECT count(*) AS news_count, coalesce(round(avg(score), 4), 0) AS average_sentiment, CASE WHEN round(avg(score), 4) >= .15 THEN 'POSITIVE' WHEN round(avg(score), 4) <= -.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label,
    CASE coalesce(max(CASE impact WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END), 1) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS impact_level, count_if(label = 'POSITIVE')::BIGINT AS positive, count_if(label = 'NEGATIVE')::BIGINT AS negative, count_if(label = 'NEUTRAL')::BIGINT AS neutral FROM m""", "news")
def market_sentiment(spark, sf):
    """Mood of all news since a date; items without a date count."""
    rows = _news(spark, sf).withColumn("published_at", F.when(F.col("item_id") % 9 != 0, F.col("published_at")))
    return text.market_mood(rows, "2000-06-01", 60)


@query("demo_news", """WITH k AS (SELECT unnest([0, 1, 2]) AS k) SELECT symbol, k::INT AS place, TIMESTAMP '2000-10-01 12:00:00' - to_hours(7 * k) AS published_at, [.42, -.34, .02][k + 1]::DOUBLE AS sentiment_score, ['POSITIVE', 'NEGATIVE', 'NEUTRAL'][k + 1] AS sentiment_label, [82, 68, 54][k + 1]::DOUBLE AS relevance_score,
    'demo://news/' || lower(symbol) || '/' || k::VARCHAR AS url FROM assets CROSS JOIN k""", "assets")
def demo_news(spark, sf):
    return demo.news(views.assets(spark, sf), "2000-10-01").select("symbol", "place", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "sentiment_score", "sentiment_label", "relevance_score", "url")


@query("selection_exits", f"""WITH RECURSIVE {ROLLING}, d AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM rolling WHERE score IS NOT NULL)), b AS (SELECT date, symbol FROM rolling WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) <= 3)
    SELECT next AS date, symbol FROM b JOIN d USING (date) WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b c WHERE c.date = d.next AND c.symbol = b.symbol)""", "prices")
def selection_exits(spark, sf):
    """What leaves the selection of the best at each date: held on the date before, not selected on it."""
    best = top_n_by_score(spark, sf).where("score IS NOT NULL").select("date", "symbol")
    days = best.select("date").distinct().withColumn("next", F.lead("date").over(W.orderBy("date"))).dropna()  # one row a trading day
    held = best.join(days, "date").select(F.col("next").alias("date"), "symbol")
    return held.join(best, ["date", "symbol"], "left_anti")


@query("training_universe", "SELECT symbol, (row_number() OVER (ORDER BY symbol))::INT AS place FROM (SELECT DISTINCT upper(symbol) AS symbol FROM prices JOIN assets USING (symbol)) QUALIFY place <= 120", "prices", "assets")
def training_universe(spark, sf):
    return learning.universe(views.prices(spark, sf), views.assets(spark, sf))
