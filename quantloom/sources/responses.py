"""Rows of prices and news from vendors' JSON responses: one response a row (symbol, body).

What can't be read is left out: bodies that aren't JSON of the expected form, entries
without the fields that they need, numbers that aren't numbers. All columns are Catalyst
expressions; a response's entries are exploded, so nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.dates import from_millis, parse_time
from quantloom.functions.numeric import finite
from quantloom.functions.text import sentiment, sentiment_label


def _number(x: Column) -> Column:
    return finite(x.try_cast("double"))


def _filled(x: Column) -> Column:
    """NULL for blank texts."""
    return F.when(F.trim(x) != "", F.trim(x))


PRICE = ["symbol", "date", "open", "high", "low", "close", "adjusted_close", "volume"]


def daily_prices(raw: DataFrame) -> DataFrame:
    """{"Time Series (Daily)": {date: {"1. open": ...}}}: bars; the adjusted close falls back to the close, volume is field 6, else 5, else 0."""
    body = F.from_json("body", "`Time Series (Daily)` map<string, map<string, string>>")
    rows = raw.select("symbol", F.explode(body["Time Series (Daily)"]).alias("date", "v"))
    field = lambda n: F.try_element_at("v", F.lit(n))
    out = rows.select(
        "symbol", F.col("date").try_cast("date").alias("date"), *[_number(field(f)).alias(n) for f, n in (("1. open", "open"), ("2. high", "high"), ("3. low", "low"), ("4. close", "close"))],
        _number(F.coalesce(_filled(field("5. adjusted close")), field("4. close"))).alias("adjusted_close"), _number(F.coalesce(_filled(field("6. volume")), _filled(field("5. volume")), F.lit("0"))).alias("volume"),
    )
    return out.dropna(subset=PRICE)


def ticks(raw: DataFrame) -> DataFrame:
    """{"prices": [[ms, price], ...], "total_volumes": [[ms, volume], ...]}: bars of each UTC day in the order given; volume is the day's last, else 0.

    A day's ticks come in one response; of several responses of a symbol, days mustn't overlap."""
    body = F.from_json("body", "prices array<array<string>>, total_volumes array<array<string>>")  # one odd entry mustn't cost the others
    rows = raw.select("symbol", body.alias("b"))

    def entries(name: str) -> DataFrame:
        each = rows.select("symbol", F.posexplode(f"b.{name}").alias("k", "x"))
        return each.select("symbol", F.to_date(from_millis(_number(F.get("x", F.lit(0))))).alias("date"), "k", _number(F.get("x", F.lit(1))).alias("v")).where("date IS NOT NULL")

    price = entries("prices").where("v IS NOT NULL").groupBy("symbol", "date").agg(F.min_by("v", "k").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "k").alias("close"))
    volume = entries("total_volumes").groupBy("symbol", "date").agg(F.max_by(F.coalesce("v", F.lit(0.0)), "k").alias("volume"))
    out = price.join(volume, ["symbol", "date"], "left")
    return out.select("symbol", "date", "open", "high", "low", "close", F.col("close").alias("adjusted_close"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def observations(raw: DataFrame) -> DataFrame:
    """{"observations": [{"date", "value"}]}: bars of one value; "." stands for none."""
    body = F.from_json("body", "observations array<struct<date: string, value: string>>")
    rows = raw.select("symbol", F.explode(body.observations).alias("x")).select("symbol", F.col("x.date").try_cast("date").alias("date"), _number(F.col("x.value")).alias("v"))
    rows = rows.dropna(subset=["date", "v"])
    return rows.select("symbol", "date", *[F.col("v").alias(c) for c in ("open", "high", "low", "close", "adjusted_close")], F.lit(0.0).alias("volume"))


NEWS = ["symbol", "title", "summary", "url", "source", "published_at", "score", "label", "relevance"]


def _label(said: Column, score: Column) -> Column:
    up = F.upper(F.coalesce(said, F.lit("")))
    return F.when(F.contains(up, F.lit("BULLISH")) | (up == "POSITIVE"), "POSITIVE").when(F.contains(up, F.lit("BEARISH")) | (up == "NEGATIVE"), "NEGATIVE").otherwise(sentiment_label(score))


def scored_news(raw: DataFrame, vendor: str = "feed") -> DataFrame:
    """{"feed": [...]} with sentiment for each ticker: that of the response's symbol, else the overall one; relevance of 0 to 1 as percent (50 where none is given)."""
    ticker = "struct<ticker: string, ticker_sentiment_score: string, ticker_sentiment_label: string, relevance_score: string>"
    item = f"struct<title: string, summary: string, url: string, source: string, time_published: string, overall_sentiment_score: string, overall_sentiment_label: string, ticker_sentiment: array<{ticker}>>"
    rows = raw.select("symbol", F.explode(F.from_json("body", f"feed array<{item}>").feed).alias("x"))
    own = F.get(F.filter("x.ticker_sentiment", lambda t: F.upper(F.coalesce(t.ticker, F.lit(""))) == F.upper("symbol")), F.lit(0))
    rows = rows.withColumn("t", own).withColumn("has", F.col("t").isNotNull())
    pick = lambda a, b: F.when(F.col("has"), F.col(a)).otherwise(F.col(b))
    score = F.coalesce(_number(pick("t.ticker_sentiment_score", "x.overall_sentiment_score")), F.lit(0.0))
    share = F.coalesce(F.when(F.col("has"), _number(F.col("t.relevance_score"))), F.lit(0.5))
    relevance = F.when(share <= 1, share * 100).otherwise(share)
    at = F.col("x.time_published")
    when = parse_time(at, "yyyyMMdd'T'HHmmss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    out = rows.select(
        "symbol", _filled(F.col("x.title")).alias("title"), F.trim(F.coalesce("x.summary", F.lit(""))).alias("summary"), _filled(F.col("x.url")).alias("url"), F.trim(F.coalesce("x.source", F.lit(vendor))).alias("source"),
        when.cast("timestamp_ntz").alias("published_at"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("score"), _label(pick("t.ticker_sentiment_label", "x.overall_sentiment_label"), score).alias("label"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), relevance)).alias("relevance"),
    )
    return out.where("title IS NOT NULL")


#: Which kinds of assets each source of prices has; the first that has a kind serves it.
PROVIDERS = {"daily": ("stock", "etf", "bond_etf"), "ticks": ("crypto",), "observations": ("macro", "bond_proxy")}


def provider_of(asset_type: Column, providers: dict[str, tuple[str, ...]] = PROVIDERS) -> Column:
    """The source that serves an asset type; NULL where none does."""
    return F.coalesce(*[F.when(F.lower(asset_type).isin(*kinds), name) for name, kinds in providers.items()])


def request_url(base: str, **parameters: Column) -> Column:
    """A request with its parameters encoded."""
    pairs = [F.concat(F.lit(f"{n}="), F.url_encode(F.coalesce(v.cast("string"), F.lit("")))) for n, v in parameters.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *pairs))


def cache_key(provider: Column, endpoint: str, symbol: Column, url: Column) -> Column:
    """provider:endpoint:SYMBOL:hash of the request."""
    return F.concat_ws(":", provider, F.lit(endpoint), F.upper(symbol), F.sha2(url, 256))


def plain_news(raw: DataFrame, vendor: str = "articles") -> DataFrame:
    """{"articles": [{headline, summary, url, source, datetime}]}: sentiment from phrases of headline and summary, relevance 75."""
    item = "struct<headline: string, summary: string, url: string, source: string, datetime: string>"
    rows = raw.select("symbol", F.explode(F.from_json("body", f"articles array<{item}>").articles).alias("x"))
    summary, seconds = F.trim(F.coalesce("x.summary", F.lit(""))), _number(F.col("x.datetime"))
    rows = rows.select("symbol", _filled(F.col("x.headline")).alias("title"), summary.alias("summary"), _filled(F.col("x.url")).alias("url"), F.trim(F.coalesce("x.source", F.lit(vendor))).alias("source"), F.when(seconds > 0, F.timestamp_seconds(seconds)).cast("timestamp_ntz").alias("published_at"))
    rows = rows.where("title IS NOT NULL").withColumn("s", sentiment(F.concat_ws(" ", "title", "summary")))
    return rows.select(*NEWS[:6], F.col("s.score").alias("score"), F.col("s.label").alias("label"), F.lit(75.0).alias("relevance"))
