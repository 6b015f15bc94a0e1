"""Queries of normalisers, imports, merges, news lists and status views, over responses and files made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import dates, numeric, text
from quantloom.sources import holdings, responses, tables

from . import views
from .catalog import NEWS, _news, query


def _bodies(rows, symbol: str, *fields):
    """One JSON response a symbol and month, of rows with a column month."""
    return rows.groupBy(symbol, "month").agg(F.to_json(F.struct(*fields)).alias("body")).select(F.col(symbol).alias("symbol"), "body")


@query("daily_price_responses", "SELECT symbol, date, open, high, low, close, close AS adjusted_close, volume FROM prices WHERE day(date) <> 13", "prices")
def daily_price_responses(spark, sf):
    """Bars written as vendor responses and read back; entries of a 13th lack their close."""
    text_of = lambda c: F.col(c).cast("string")
    close = F.when(F.dayofmonth("date") != 13, text_of("close"))
    fields = F.map_from_arrays(F.array(*map(F.lit, ("1. open", "2. high", "3. low", "4. close", "5. volume"))), F.array(text_of("open"), text_of("high"), text_of("low"), close, text_of("volume")))
    rows = views.prices(spark, sf).withColumn("month", F.trunc("date", "month")).withColumn("entry", F.struct(text_of("date"), fields))
    return responses.daily_prices(_bodies(rows, "symbol", F.map_from_entries(F.collect_list("entry")).alias("Time Series (Daily)"))).select(*responses.PRICE)


@query("tick_responses", """SELECT event_type AS symbol, ts::DATE AS date, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, arg_max(event_id, event_id)::DOUBLE AS volume FROM events GROUP BY ALL""")
def tick_responses(spark, sf):
    rows = views.table(spark, sf, "events").withColumns({"month": F.to_date("ts"), "ms": F.unix_millis(F.col("ts").cast("timestamp")).cast("double")})
    listed = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("event_id", "ms", F.col(v).cast("double").alias("v")))), lambda x: F.array(x.ms, x.v))
    out = responses.ticks(_bodies(rows, "event_type", listed("value").alias("prices"), listed("event_id").alias("total_volumes")))
    return out.drop("adjusted_close")


@query("observation_responses", "SELECT o_orderpriority AS symbol, o_orderdate::DATE AS date, o_totalprice AS close, 0.0::DOUBLE AS volume FROM orders WHERE o_orderkey % 7 <> 0")
def observation_responses(spark, sf):
    rows = views.table(spark, sf, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
    value = F.when(F.col("o_orderkey") % 7 == 0, F.lit(".")).otherwise(F.col("o_totalprice").cast("string"))
    entry = F.struct(F.to_date("o_orderdate").cast("string").alias("date"), value.alias("value"))
    return responses.observations(_bodies(rows, "o_orderpriority", F.collect_list(entry).alias("observations"))).select("symbol", "date", "close", "volume")


ITEMS = """i AS (SELECT doc_id, 'Brand#' || (doc_id % 25 + 1)::VARCHAR AS symbol, (doc_id % 21 - 10) / 10::DOUBLE AS s, (doc_id % 150) / 100::DOUBLE AS rel, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 3600) AS t FROM documents)"""


@query("scored_news_responses", f"""WITH {ITEMS} SELECT symbol, 'Item ' || doc_id::VARCHAR AS title, CASE WHEN doc_id % 5 <> 0 THEN 'u/' || doc_id::VARCHAR END AS url, t AS published_at, CASE WHEN doc_id % 3 = 0 THEN s ELSE -s END AS score,
    CASE WHEN doc_id % 3 = 0 THEN 'POSITIVE' WHEN -s >= .15 THEN 'POSITIVE' WHEN -s <= -.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label, CASE WHEN doc_id % 3 <> 0 THEN 50 WHEN rel <= 1 THEN rel * 100 ELSE rel END::DOUBLE AS relevance FROM i WHERE doc_id % 11 <> 0""")
def scored_news_responses(spark, sf):
    """A response a document: every third has sentiment of its own ticker, every eleventh no title, times in three forms."""
    c, at = F.col("doc_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    rows = views.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Brand#"), (c % 25 + 1).cast("string")).alias("symbol"))
    score = ((c % 21 - 10) / 10).cast("string")
    when = F.when(c % 3 == 0, F.date_format(at, "yyyyMMdd'T'HHmmss")).when(c % 3 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    other = F.struct(F.lit("OTHER").alias("ticker"), F.lit("0.9").alias("ticker_sentiment_score"), F.lit("Bearish").alias("ticker_sentiment_label"), F.lit("0.1").alias("relevance_score"))
    own = F.struct(F.lower("symbol").alias("ticker"), score.alias("ticker_sentiment_score"), F.lit("Somewhat-Bullish").alias("ticker_sentiment_label"), ((c % 150) / 100).cast("string").alias("relevance_score"))
    item = F.struct(
        F.when(c % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Item "), c.cast("string"))).alias("title"), F.when(c % 5 != 0, F.concat(F.lit("u/"), c.cast("string"))).otherwise("").alias("url"), when.alias("time_published"),
        (-(c % 21 - 10) / 10).cast("string").alias("overall_sentiment_score"), F.when(c % 3 == 0, F.array(other, own)).otherwise(F.array(other)).alias("ticker_sentiment"),
    )
    return responses.scored_news(rows.select("symbol", F.to_json(F.struct(F.array(item).alias("feed"))).alias("body"))).select("symbol", "title", "url", "published_at", "score", "label", "relevance")


@query("plain_news_responses", """WITH x AS (SELECT doc_id, doc_id % 5 AS k FROM documents) SELECT 'Brand#' || (doc_id % 25 + 1)::VARCHAR AS symbol, 'Item ' || doc_id::VARCHAR AS title, CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) END AS published_at,
    CASE k WHEN 0 THEN .44 WHEN 1 THEN -.76 WHEN 2 THEN 0 WHEN 3 THEN .76 ELSE 0 END::DOUBLE AS score, CASE k WHEN 0 THEN 'POSITIVE' WHEN 1 THEN 'NEGATIVE' WHEN 3 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS label, 75.0::DOUBLE AS relevance FROM x""")
def plain_news_responses(spark, sf):
    """Summaries with the phrases that the sentiment knows: one good, two bad, one of each, two good, none."""
    c = F.col("doc_id")
    said = F.element_at(F.array(*map(F.lit, ("An upgrade.", "Lawsuit, then a GUIDANCE CUT", "Upgrade after a recall", "buyback and partnership", "Nothing"))), (c % 5 + 1).cast("int"))
    item = F.struct(F.concat(F.lit("Item "), c.cast("string")).alias("headline"), said.alias("summary"), F.when(c % 4 != 0, F.lit(1704067200) + c).otherwise(0).alias("datetime"))
    rows = views.table(spark, sf, "documents").select(F.concat(F.lit("Brand#"), (c % 25 + 1).cast("string")).alias("symbol"), F.to_json(F.struct(F.array(item).alias("articles"))).alias("body"))
    return responses.plain_news(rows).select("symbol", "title", "published_at", "score", "label", "relevance")


@query("holdings_import", """SELECT upper('x' || p_partkey::VARCHAR) AS symbol, CASE WHEN p_partkey % 4 = 0 THEN 'etf' ELSE 'stock' END AS asset_type, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_size * 1000 + 125) / 100::DOUBLE END AS quantity, p_retailprice AS average_price,
    CASE WHEN p_partkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN p_partkey % 9 = 0 THEN 'not a number: quantity' END AS error FROM part""")
def holdings_import(spark, sf):
    """Rows as a sheet has them: Italian headers, numbers in four forms, every ninth quantity unreadable."""
    c, n = F.col("p_partkey"), F.format_number((F.col("p_size") * 1000 + 125) / 100, 2)
    swap = F.translate(n, ".,", ",.")
    quantity = F.when(c % 9 == 0, "12..3.4,5,6").when(c % 4 == 0, swap).when(c % 4 == 1, F.concat(F.lit("€ "), n)).when(c % 4 == 2, F.concat(n, F.lit(" $"))).otherwise(F.replace(n, F.lit(","), F.lit("")))
    price = F.regexp_replace(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), r"\.", ",")
    cells = F.array(F.concat(F.lit(" x"), c.cast("string")), quantity, price, F.when(c % 4 == 0, "ETF").otherwise("thing"), F.when(c % 3 == 0, "").otherwise("usd"))
    return holdings.holdings(views.table(spark, sf, "part").select(cells.alias("cells")), ["Simbolo", "Quantità", "Prezzo  medio", "tipo", "Valuta"]).drop("name")


def history(spark, sf):
    """Bars with their source: seed (filled lines) or real (open lines); a symbol and date may have both."""
    rows = views.table(spark, sf, "lineitem").join(views.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = rows.groupBy(F.col("p_brand").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), (F.col("l_linestatus") == "O").alias("is_real"))
    return out.agg(F.max("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume")).withColumn("id", F.when(F.col("is_real"), 2).otherwise(1))


HISTORY = """hist AS (SELECT p_brand AS symbol, date_trunc('week', l_shipdate)::DATE AS date, l_linestatus = 'O' AS is_real, max(l_extendedprice) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@query("price_upsert", f"""WITH {HISTORY}, o AS (SELECT * FROM hist WHERE NOT is_real), n AS (SELECT * FROM hist WHERE is_real)
    SELECT symbol, date, coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume, n.close IS NOT NULL AS is_real, CASE WHEN n.close IS NULL THEN 'kept' WHEN o.close IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM o FULL JOIN n USING (symbol, date)""")
def price_upsert(spark, sf):
    """Real bars taken into the seeded ones."""
    rows = history(spark, sf)
    new = rows.where("is_real").select("symbol", "date", "close", "volume", F.lit(1).alias("seq"))
    return tables.upsert_prices(rows.where("NOT is_real"), new).select("symbol", "date", "close", "volume", "is_real", "action")


@query("data_status", f"""WITH {HISTORY} SELECT symbol, count(*) AS total_rows, count_if(is_real)::BIGINT AS real_rows, max(date) AS last_update, CASE WHEN count_if(is_real) = 0 THEN 'SEED' WHEN count_if(is_real) = count(*) THEN 'REAL' ELSE 'MIXED' END AS data_mode FROM hist GROUP BY symbol""")
def data_status(spark, sf):
    out = history(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("is_real").alias("real_rows"), F.max("date").alias("last_update"))
    mode = F.when((F.col("total_rows") == 0) | (F.col("real_rows") == 0), "SEED").when(F.col("real_rows") == F.col("total_rows"), "REAL").otherwise("MIXED")
    return out.withColumn("data_mode", mode)


def _stories(spark, sf):
    c = F.col("doc_id")
    url = F.when(c % 5 != 0, F.concat(F.lit("u/"), (c % 60).cast("string")))
    day = F.date_add(F.lit("1999-01-04").cast("date"), (c * 7 % 700).cast("int"))
    return views.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Brand#"), (c % 5 + 1).cast("string")).alias("symbol"), url.alias("url"), F.concat(F.lit("Item "), (c % 40).cast("string")).alias("title"), day.alias("published_at"))


@query("news_upsert", """WITH st AS (SELECT doc_id, 'Brand#' || (doc_id % 5 + 1)::VARCHAR AS symbol, CASE WHEN doc_id % 5 <> 0 THEN 'u/' || (doc_id % 60)::VARCHAR END AS url, 'Item ' || (doc_id % 40)::VARCHAR AS title, DATE '1999-01-04' + (doc_id * 7 % 700)::INT AS published_at FROM documents),
    o AS (SELECT *, doc_id AS id FROM st WHERE doc_id % 3 = 0), n1 AS (SELECT * FROM st WHERE doc_id % 2 = 0 QUALIFY url IS NULL OR row_number() OVER (PARTITION BY symbol, url ORDER BY doc_id DESC) = 1),
    n2 AS (SELECT * FROM n1 QUALIFY row_number() OVER (PARTITION BY symbol, title, published_at ORDER BY doc_id DESC) = 1),
    m AS (SELECT n2.*, coalesce((SELECT min(id) FROM o WHERE o.symbol = n2.symbol AND o.url = n2.url), (SELECT min(id) FROM o WHERE o.symbol = n2.symbol AND o.title = n2.title AND o.published_at = n2.published_at)) AS id FROM n2),
    m2 AS (SELECT * FROM m QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1)
    SELECT id, symbol, url, title, published_at, CASE WHEN id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM m2 UNION ALL SELECT id, symbol, url, title, published_at, 'kept' FROM o WHERE id NOT IN (SELECT id FROM m2 WHERE id IS NOT NULL)""")
def news_upsert(spark, sf):
    rows = _stories(spark, sf)
    old = rows.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "id")
    return tables.upsert_news(old, rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "seq")).select("id", "symbol", "url", "title", "published_at", "action")


def news_list(rows, symbol: str | None = None, impact: str | None = None, most: int = 50):
    """The latest items, of a symbol or impact where one is named, 1 to 200 of them."""
    if symbol:
        rows = rows.where(F.upper("symbol") == symbol.upper())
    if impact:
        rows = rows.where(F.col("impact") == impact.upper())
    return rows.orderBy(F.desc_nulls_last("published_at"), F.desc("item_id")).limit(max(1, min(200, most)))


@query("latest_news", f"WITH {NEWS} SELECT item_id, symbol, published_at, score, label, impact FROM scored WHERE upper(symbol) = 'BRAND#7' AND impact = 'MEDIUM' ORDER BY published_at DESC, item_id DESC LIMIT 20", "news")
def latest_news(spark, sf):
    return news_list(_news(spark, sf).drop("relevance"), "brand#7", "medium", 20)


@query("news_status", f"WITH {NEWS} SELECT count(*) AS items, max(published_at) AS last_item, count_if(impact = 'HIGH')::BIGINT AS high, count(DISTINCT symbol) AS symbols FROM scored", "news")
def news_status(spark, sf):
    return _news(spark, sf).agg(F.count(F.lit(1)).alias("items"), F.max("published_at").alias("last_item"), F.count_if(F.col("impact") == "HIGH").alias("high"), F.count_distinct("symbol").alias("symbols"))


@query("order_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS daily, strftime(o_orderdate, '%Y-%m') AS monthly, isoyear(o_orderdate)::VARCHAR || '-' || week(o_orderdate)::VARCHAR AS weekly, isodow(o_orderdate) < 6 AS weekday, greatest(DATE '1998-01-01' - o_orderdate::DATE, 0)::INT AS held, round(greatest(DATE '1998-01-01' - o_orderdate::DATE, 1) / 365.25::DOUBLE, 5) AS years FROM orders""")
def order_dates(spark, sf):
    day, to = F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")
    keys = {n: dates.rebalance_key(day, n.upper()) for n in ("daily", "monthly", "weekly")}
    return views.table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in keys.items()], dates.is_weekday(day).alias("weekday"), dates.holding_days(day, to).alias("held"), F.round(dates.years_between(day, to), 5).alias("years"))


@query("part_numbers", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN 0 ELSE p_retailprice END::DOUBLE AS parsed, greatest(0, least(100, p_retailprice / 15))::DOUBLE AS clamped, round(CASE WHEN p_size = 7 THEN 0 ELSE p_retailprice / (p_size - 7) END, 4) AS safe, CASE WHEN p_size % 4 = 0 THEN -1 WHEN p_size % 4 = 3 THEN 0 ELSE 1 END AS encoded, contains(lower(p_name || ' ' || p_type), 'small') AS has_small FROM part""")
def part_numbers(spark, sf):
    """Numbers, labels and filters as the scalar functions see them."""
    c, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(18,2)")
    us = F.format_number(price, 2)
    said = F.when(c % 6 == 0, "1.2.3,4,5").when(c % 6 == 1, " ").when(c % 6 == 2, us).when(c % 6 == 3, F.translate(us, ".,", ",.")).when(c % 6 == 4, F.concat(F.lit("£ "), price.cast("string"))).otherwise(F.translate(price.cast("string"), ".", ","))
    ratio = F.when(F.col("p_size") == 7, F.lit(float("nan"))).otherwise(F.try_divide("p_retailprice", F.col("p_size") - 7))
    label = F.element_at(F.array(*map(F.lit, ("DRAWDOWN_RISK", "NON_POSITIVE_RETURN", "OUTPERFORM", "HOLD"))), (F.col("p_size") % 4 + 1))
    return views.table(spark, sf, "part").select("p_partkey", text.parse_number(said).alias("parsed"), numeric.clamp(F.col("p_retailprice") / 15).alias("clamped"), numeric.round_safe(ratio, 4).alias("safe"), text.encode_label(label).alias("encoded"), text.contains_any("SMALL", F.col("p_name"), F.col("p_type")).alias("has_small"))


@query("provider_keys", """WITH p AS (SELECT symbol, asset_type, CASE WHEN asset_type IN ('stock', 'etf', 'bond_etf') THEN 'daily' WHEN asset_type = 'crypto' THEN 'ticks' END AS provider, 'https://prices.example/query?symbol=' || url_encode(symbol) || '&kind=' || url_encode(asset_type) AS url FROM assets)
    SELECT symbol, asset_type, provider, url, provider || ':prices:' || upper(symbol) || ':' || sha256(url) AS cache_key FROM p WHERE provider IS NOT NULL""", "assets")
def provider_keys(spark, sf):
    """Which source serves each asset, and the key under which its response is cached."""
    rows = views.assets(spark, sf).withColumn("provider", responses.provider_of(F.col("asset_type"))).where("provider IS NOT NULL")
    rows = rows.withColumn("url", responses.request_url("https://prices.example/query", symbol=F.col("symbol"), kind=F.col("asset_type")))
    return rows.select("symbol", "asset_type", "provider", "url", responses.cache_key(F.col("provider"), "prices", F.col("symbol"), F.col("url")).alias("cache_key"))


@query("news_cache", """WITH c AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'scored_news' WHEN 1 THEN 'plain_news' ELSE 'daily' END AS provider, CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 3600) END AS expires_at FROM documents)
    SELECT count(*) AS entries, count_if(coalesce(expires_at > TIMESTAMP '2024-01-10 00:00:00', FALSE))::BIGINT AS valid, count_if(NOT coalesce(expires_at > TIMESTAMP '2024-01-10 00:00:00', FALSE))::BIGINT AS expired FROM c WHERE provider LIKE '%news%'""")
def news_cache(spark, sf):
    """Cached responses of the sources of news, valid and expired at a time."""
    c = F.col("doc_id")
    rows = views.table(spark, sf, "documents").select(F.when(c % 4 == 0, "scored_news").when(c % 4 == 1, "plain_news").otherwise("daily").alias("provider"), F.when(c % 7 != 0, F.date_format(F.timestamp_seconds(F.lit(1704067200) + c * 3600), "yyyy-MM-dd'T'HH:mm:ss")).alias("expires_at"))
    return tables.cache_stats(rows.where(F.col("provider").like("%news%")), "2024-01-10 00:00:00")


@query("signal_layouts", """WITH o AS (SELECT o_orderkey AS id, 'Brand#' || (o_orderkey % 5 + 1)::VARCHAR || (o_orderkey % 5 + 1)::VARCHAR AS s, o_orderkey % 101 AS x, o_orderdate::DATE AS day FROM orders)
    SELECT id, coalesce(CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN lower(s) END, s) AS symbol, x::DOUBLE AS score, CASE WHEN id % 2 = 0 AND id % 5 <> 0 THEN x - 1 ELSE x END::DOUBLE AS technical_score, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END::DOUBLE AS news_score, coalesce(CASE WHEN id % 2 = 1 THEN 'low' END, a.risk_level) AS risk_level, CASE WHEN id % 2 = 0 THEN 'summary' ELSE 'rationale' END AS summary, day AS created_at FROM o JOIN assets a ON a.symbol = s""", "assets")
def signal_layouts(spark, sf):
    """Signals of an older layout (score, rationale, generated_at) and a newer one (final_score, technical_summary, created_at) as one list."""
    c, x = F.col("o_orderkey"), (F.col("o_orderkey") % 101).cast("double")
    rows = views.table(spark, sf, "orders").withColumn("of", F.concat(F.lit("Brand#"), (c % 5 + 1).cast("string"), (c % 5 + 1).cast("string")))
    old = rows.where(c % 2 == 1).select(c.alias("id"), "of", x.alias("score"), F.lit("low").alias("risk_level"), F.lit("rationale").alias("rationale"), F.to_date("o_orderdate").alias("generated_at"))
    new = rows.where(c % 2 == 0).select(c.alias("id"), "of", F.when(c % 3 != 0, F.lower("of")).alias("symbol"), x.alias("final_score"), x.alias("score"), F.when(c % 5 != 0, x - 1).alias("technical_score"), F.lit(1.0).alias("news_score"), F.lit("summary").alias("technical_summary"), F.to_date("o_orderdate").alias("created_at"))
    known = views.assets(spark, sf).select(F.col("symbol").alias("of"), F.col("risk_level").alias("asset_risk"))
    told = [t.join(known, "of").withColumn("none", F.lit(0.0)) for t in (old, new)]
    return tables.layouts(told, id=("id",), symbol=("symbol", "of"), score=("final_score", "score"), technical_score=("technical_score", "score"), news_score=("news_score", "none"), risk_level=("risk_level", "asset_risk"), summary=("technical_summary", "rationale"), created_at=("created_at", "generated_at"))


@query("order_layouts", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS order_type, l_shipdate::DATE + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS order_date, CASE WHEN l_linenumber % 2 = 0 THEN 'old' WHEN l_linenumber % 5 <> 0 THEN 'new' END AS note FROM lineitem""")
def order_layouts(spark, sf):
    """Orders of an older layout (order_type, order_date, note) and a newer one (side, executed_at, notes) as one list."""
    c, side = F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    rows, ship, made = views.table(spark, sf, "lineitem"), F.to_date("l_shipdate"), F.date_add(F.to_date("l_shipdate"), 1)
    old = rows.where(c % 2 == 0).select("l_orderkey", c, side.alias("order_type"), F.when(c % 3 != 0, ship).alias("order_date"), made.alias("created_at"), F.lit("old").alias("note"))
    new = rows.where(c % 2 == 1).select("l_orderkey", c, side.alias("side"), F.when(c % 3 != 0, ship).alias("executed_at"), made.alias("created_at"), F.when(c % 5 != 0, "new").alias("notes"))
    return tables.layouts([old, new], l_orderkey=("l_orderkey",), l_linenumber=("l_linenumber",), order_type=("order_type", "side"), order_date=("order_date", "executed_at", "created_at"), note=("note", "notes"))
