"""Every analytics query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import numeric, text
from quantloom.operators import backtest, indicators, portfolio

from . import views
from .views import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = 5


def query(name: str, body: str | None = None, *needs: str):
    def add(f):
        QUERIES[name] = f
        if body:
            SQL[name] = sql(body, *needs)
        return f

    return add


def rounded(df: DataFrame, *keep: str, digits: int = DIGITS) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in keep])


def r(names: str) -> str:
    """SQL that rounds the named columns."""
    return ", ".join(f"round({n}, {DIGITS}) AS {n}" for n in names.split())


def full(n: int, x: str, value: str) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {value} {over} END"


W1 = "(PARTITION BY symbol ORDER BY date)"


@query("weekly_bars", "SELECT symbol, date, open, high, low, close, volume FROM prices", "prices")
def weekly_bars(spark: SparkSession, sf: str) -> DataFrame:
    return views.prices(spark, sf).select("symbol", "date", "open", "high", "low", "close", "volume")


@query("event_bars", """SELECT event_type AS symbol, time_bucket(INTERVAL 3 HOURS, ts) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
    FROM events GROUP BY ALL""")
def event_bars(spark, sf):
    t = views.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.window("ts", "3 hours").start.cast("timestamp_ntz").alias("date"), F.struct("ts", "event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"))
    return views.bars(t)


@query("price_tail", "SELECT symbol, date, close FROM prices QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 10", "prices")
def price_tail(spark, sf):
    late = W.partitionBy("symbol").orderBy(F.desc("date"))
    return views.prices(spark, sf).withColumn("k", F.row_number().over(late)).where("k <= 10").select("symbol", "date", "close")


LATEST = f"""latest AS (SELECT symbol, date, close, lag(close) OVER {W1} AS previous_close FROM prices QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"""


@query("latest_price_metrics", f"WITH {LATEST} SELECT symbol, date, close, previous_close, round((close / nullif(previous_close, 0) - 1) * 100, 5) AS change_percent FROM latest", "prices")
def latest_price_metrics(spark, sf):
    return rounded(portfolio.latest(views.prices(spark, sf)), "symbol", "date", "close", "previous_close", "change_percent")


TREND = "t AS (SELECT *, " + ", ".join(f"{full(n, 'close', 'avg(close)')} AS sma_{n}" for n in (10, 20, 50, 100, 200)) + " FROM prices)"


@query("sma_crosses", f"""WITH {TREND} SELECT symbol, date, {r('sma_10 sma_20 sma_50 sma_100 sma_200')},
    coalesce(sma_50 > sma_200 AND lag(sma_50) OVER {W1} <= lag(sma_200) OVER {W1}, FALSE) AS golden_cross, coalesce(sma_50 < sma_200 AND lag(sma_50) OVER {W1} >= lag(sma_200) OVER {W1}, FALSE) AS death_cross FROM t""", "prices")
def sma_crosses(spark, sf):
    return rounded(indicators.trend(views.prices(spark, sf)), "symbol", "date", "sma_10", "sma_20", "sma_50", "sma_100", "sma_200", "golden_cross", "death_cross")


OSC = f"""m AS (SELECT *, lag(close) OVER {W1} AS b, lag(close, 12) OVER {W1} AS b12 FROM prices),
    n AS (SELECT *, greatest(close - b, 0.0) * (b - b + 1) AS up, greatest(b - close, 0.0) * (b - b + 1) AS down, greatest(high - low, abs(high - b), abs(low - b)) AS tr FROM m),
    o AS (SELECT *, {full(14, 'up', 'avg(up)')} AS g, {full(14, 'down', 'avg(down)')} AS l, {full(14, 'tr', 'avg(tr)')} AS atr_14, (close / b12 - 1) * 100 AS roc_12,
    (close - {full(14, 'low', 'min(low)')}) * 100 / nullif({full(14, 'high', 'max(high)')} - {full(14, 'low', 'min(low)')}, 0) AS stochastic_k FROM n),
    osc AS (SELECT *, CASE WHEN l = 0 AND g > 0 THEN 100.0 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END AS rsi_14, {full(3, 'stochastic_k', 'avg(stochastic_k)')} AS stochastic_d FROM o)"""


@query("oscillators", f"WITH {OSC} SELECT symbol, date, {r('rsi_14 stochastic_k stochastic_d roc_12 atr_14')} FROM osc", "prices")
def oscillators(spark, sf):
    return rounded(indicators.oscillators(views.prices(spark, sf)), "symbol", "date", "rsi_14", "stochastic_k", "stochastic_d", "roc_12", "atr_14")


@query("bands_volatility", f"""WITH m AS (SELECT *, (high + low + close) / 3 AS tp, close / lag(close) OVER {W1} - 1 AS ret FROM prices),
    n AS (SELECT *, {full(20, 'close', 'avg(close)')} AS bollinger_middle, {full(20, 'close', 'stddev_samp(close)')} AS sd, {full(20, 'tp', 'avg(tp)')} AS mean, {full(30, 'ret', 'stddev_samp(ret)')} * sqrt(252) AS volatility_30,
    list(tp) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS tps FROM m),
    o AS (SELECT *, bollinger_middle + 2 * sd AS bollinger_upper, bollinger_middle - 2 * sd AS bollinger_lower, list_avg(list_transform(tps, lambda x: abs(x - mean))) AS spread FROM n)
    SELECT symbol, date, {r('bollinger_middle bollinger_upper bollinger_lower volatility_30')}, round((close - bollinger_lower) / nullif(bollinger_upper - bollinger_lower, 0), 5) AS percent_b, round((tp - mean) / nullif(.015 * spread, 0), 5) AS cci_20 FROM o""", "prices")
def bands_volatility(spark, sf):
    return rounded(indicators.bands(views.prices(spark, sf)), "symbol", "date", "bollinger_middle", "bollinger_upper", "bollinger_lower", "volatility_30", "percent_b", "cci_20")


@query("drawdown_curve", f"WITH d AS (SELECT *, close / max(close) OVER {W1} - 1 AS drawdown FROM prices) SELECT symbol, date, round(drawdown, 5) AS drawdown, round(min(drawdown) OVER {W1}, 5) AS max_drawdown FROM d", "prices")
def drawdown_curve(spark, sf):
    return rounded(indicators.drawdowns(views.prices(spark, sf)), "symbol", "date", "drawdown", "max_drawdown")


def _mid(n: int) -> str:
    return f"({full(n, 'high', 'max(high)')} + {full(n, 'low', 'min(low)')}) / 2"


@query("cloud_and_volume", f"""WITH m AS (SELECT *, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS b, lead(close, 26) OVER {W1} AS chikou, coalesce(sign(close - lag(close) OVER {W1}) * volume, 0) AS flow, {full(20, 'volume', 'avg(volume)')} AS volume_sma_20 FROM prices),
    n AS (SELECT *, lag((tenkan + kijun) / 2, 26) OVER {W1} AS senkou_a, lag(b, 26) OVER {W1} AS senkou_b, sum(flow) OVER {W1} AS obv, volume / nullif(volume_sma_20, 0) AS volume_ratio_20 FROM m)
    SELECT symbol, date, {r('tenkan kijun senkou_a senkou_b chikou obv volume_sma_20 volume_ratio_20')} FROM n""", "prices")
def cloud_and_volume(spark, sf):
    return rounded(indicators.cloud_and_volume(views.prices(spark, sf)), "symbol", "date", "tenkan", "kijun", "senkou_a", "senkou_b", "chikou", "obv", "volume_sma_20", "volume_ratio_20")


@query("support_resistance", f"""WITH m AS (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 180),
    n AS (SELECT *, count(*) OVER v AS k, max(high) OVER v AS hi, min(low) OVER v AS lo, arg_max(close, date) OVER (PARTITION BY symbol) AS c FROM m WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    o AS (SELECT symbol, any_value(c) AS close, max(low) FILTER (WHERE k = 5 AND low = lo AND low <= c) AS support, min(high) FILTER (WHERE k = 5 AND high = hi AND high >= c) AS resistance FROM n GROUP BY symbol)
    SELECT symbol, close, support, resistance, round((close - support) / nullif(close, 0) * 100, 5) AS support_percent, round((resistance - close) / nullif(close, 0) * 100, 5) AS resistance_percent FROM o""", "prices")
def support_resistance(spark, sf):
    return rounded(indicators.pivots(views.prices(spark, sf)), "symbol", "close", "support", "resistance", "support_percent", "resistance_percent")


@query("ema_macd", f"""WITH RECURSIVE p AS (SELECT symbol, date, close, row_number() OVER {W1} AS k FROM prices),
    e AS (SELECT symbol, k, date, close AS ema_12, close AS ema_26, 0.0::DOUBLE AS macd_signal FROM p WHERE k = 1
    UNION ALL SELECT p.symbol, p.k, p.date, 2 / 13.0::DOUBLE * close + 11 / 13.0::DOUBLE * ema_12, 2 / 27.0::DOUBLE * close + 25 / 27.0::DOUBLE * ema_26,
    .2::DOUBLE * ((2 / 13.0::DOUBLE * close + 11 / 13.0::DOUBLE * ema_12) - (2 / 27.0::DOUBLE * close + 25 / 27.0::DOUBLE * ema_26)) + .8::DOUBLE * macd_signal FROM e JOIN p ON p.symbol = e.symbol AND p.k = e.k + 1)
    SELECT symbol, date, round(ema_12, 3) AS ema_12, round(ema_26, 3) AS ema_26, round(ema_12 - ema_26, 3) AS macd_line, round(macd_signal, 3) AS macd_signal FROM e""", "prices")
def ema_macd(spark, sf):
    return rounded(indicators.recursive(views.prices(spark, sf)), "symbol", "date", "ema_12", "ema_26", "macd_line", "macd_signal", digits=3)


@query("forward_targets", f"""WITH m AS (SELECT *, lead(close, 4) OVER {W1} / close - 1 AS future_return, lead(date, 4) OVER {W1} AS target_date,
    CASE WHEN count(*) OVER v = 4 THEN min(close) OVER v / close - 1 END AS worst FROM prices WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))
    SELECT symbol, date, round(future_return, 5) AS future_return, target_date, round(worst, 5) AS worst, (future_return > 0)::INT AS positive_return, (worst <= -0.08)::INT AS drawdown_risk FROM m""", "prices")
def forward_targets(spark, sf):
    return rounded(indicators.targets(views.prices(spark, sf)), "symbol", "date", "future_return", "target_date", "worst", "positive_return", "drawdown_risk")


@query("walk_forward_folds", "WITH d AS (SELECT DISTINCT date FROM prices) SELECT date, least((row_number() OVER (ORDER BY date) - 1) // (count(*) OVER () // 4), 3)::INT AS fold FROM d", "prices")
def walk_forward_folds(spark, sf):
    return backtest.folds(views.prices(spark, sf).select("date").distinct(), 4)


@query("asof_close_grid", """WITH g AS (SELECT * FROM (SELECT DISTINCT date FROM prices), (SELECT DISTINCT symbol FROM prices))
    SELECT g.symbol, g.date, p.close FROM g ASOF JOIN prices p ON g.symbol = p.symbol AND g.date >= p.date""", "prices")
def asof_close_grid(spark, sf):
    return backtest.asof_grid(views.prices(spark, sf), "close")


def _keywords(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


NEWS = f"""h AS (SELECT *, {_keywords(views.NEWS_POSITIVE)} AS up, {_keywords(views.NEWS_NEGATIVE)} AS down FROM news),
    s AS (SELECT *, round(greatest(-1, least(1, (up - down) * .32 + CASE WHEN up > 0 AND down = 0 THEN .12 WHEN down > 0 AND up = 0 THEN -.12 ELSE 0 END)), 3)::DOUBLE AS score FROM h),
    scored AS (SELECT *, CASE WHEN score >= .15 THEN 'POSITIVE' WHEN score <= -.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
    CASE WHEN (relevance >= 80 AND (abs(score) >= .4 OR up + down >= 1)) OR (relevance >= 65 AND abs(score) >= .55) THEN 'HIGH' WHEN relevance >= 50 OR abs(score) >= .25 OR up + down >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM s)"""


def _news(spark, sf):
    rows = views.news(spark, sf)
    both = text.hits(F.col("text"), views.NEWS_POSITIVE) + text.hits(F.col("text"), views.NEWS_NEGATIVE)
    rows = rows.withColumn("s", text.sentiment(F.col("text"), views.NEWS_POSITIVE, views.NEWS_NEGATIVE)).withColumn("hits", both).drop("text")
    return rows.select("item_id", "symbol", "published_at", "relevance", "s.score", "s.label", text.impact(F.col("relevance"), F.col("s.score"), F.col("hits")).alias("impact"))


@query("news_sentiment", f"WITH {NEWS} SELECT item_id, symbol, published_at, score, label, impact FROM scored", "news")
def news_sentiment(spark, sf):
    return _news(spark, sf).select("item_id", "symbol", "published_at", "score", "label", "impact")


@query("news_rollup", f"""WITH {NEWS} SELECT symbol, count(*) AS n, round(avg(score), 4) AS sentiment, count_if(label = 'POSITIVE')::BIGINT AS positive, count_if(label = 'NEGATIVE')::BIGINT AS negative,
    max(CASE impact WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)::INT AS impact FROM scored GROUP BY symbol""", "news")
def news_rollup(spark, sf):
    out = _news(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("sentiment"), F.count_if(F.col("label") == "POSITIVE").alias("positive"), F.count_if(F.col("label") == "NEGATIVE").alias("negative"), F.max(numeric.ordinal(F.col("impact"), "LOW", "MEDIUM", "HIGH")).alias("impact"))
    return out


@query("trailing_news", f"""WITH {NEWS} SELECT p.symbol, p.date, count(s.item_id) AS n, round(avg(s.score), 4) AS sentiment FROM prices p LEFT JOIN scored s ON s.symbol = p.symbol AND s.published_at > p.date - 7 AND s.published_at <= p.date GROUP BY p.symbol, p.date""", "prices", "news")
def trailing_news(spark, sf):
    """Sums of each day, then a range of seven days over the union of news days and bars: no range join."""
    day = _news(spark, sf).groupBy("symbol", F.col("published_at").alias("date")).agg(F.count(F.lit(1)).alias("k"), F.sum("score").alias("t"))
    rows = views.prices(spark, sf).select("symbol", "date", F.lit(True).alias("bar")).join(day, ["symbol", "date"], "full")
    week = W.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-6, 0)
    rows = rows.select("symbol", "date", "bar", F.coalesce(F.sum("k").over(week), F.lit(0)).alias("n"), F.sum("t").over(week).alias("t"))
    return rows.where("bar").select("symbol", "date", "n", F.round(F.try_divide("t", "n"), 4).alias("sentiment"))


@query("dashboard_counts", "SELECT asset_type, risk_level, count(*) AS n FROM assets GROUP BY ALL", "assets")
def dashboard_counts(spark, sf):
    return views.assets(spark, sf).groupBy("asset_type", "risk_level").agg(F.count(F.lit(1)).alias("n"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return views.table(spark, sf, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


from . import books, feeds, learning, ledger, records, runs, technical  # noqa: E402, F401 (they register their queries)
