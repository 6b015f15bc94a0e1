"""Queries of recursive indicators, scores and signals."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators import indicators, scoring
from quantloom.sources import scratch

from . import views
from .catalog import NEWS, OSC, TREND, W1, _mid, _news, full, query, r, rounded

REC = f"""p0 AS (SELECT *, row_number() OVER {W1} AS k, lag(close) OVER {W1} AS pc, lag(high) OVER {W1} AS ph, lag(low) OVER {W1} AS pl FROM prices),
    p1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, (high + low) / 2 AS mid, (CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END)::DOUBLE AS up, (CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END)::DOUBLE AS dn FROM p0),
    p2 AS (SELECT *, 3 * ({full(10, 'tr', 'avg(tr)')}) AS wide FROM p1),
    rec AS (SELECT symbol, k, date, close AS e12, close AS e26, close AS e50, close AS e200, 0.0::DOUBLE AS sg, tr AS wa, up AS wu, dn AS wd, NULL::DOUBLE AS ax, 0 AS an, 1.0::DOUBLE AS aw, NULL::DOUBLE AS top, NULL::DOUBLE AS bot, NULL::BOOLEAN AS ris FROM p2 WHERE k = 1
    UNION ALL SELECT symbol, k, date, e12, e26, e50, e200, .2::DOUBLE * (e12 - e26) + .8::DOUBLE * sg, wa, wu, wd,
        CASE WHEN dx IS NULL THEN ax WHEN ax IS NULL THEN dx ELSE (aw * 13 / 14 * ax + dx / 14) / (aw * 13 / 14 + 1 / 14) END, an + (dx IS NOT NULL)::INT, CASE WHEN dx IS NULL THEN aw * 13 / 14 ELSE 1 END,
        top, bot, CASE WHEN wide IS NULL THEN ris WHEN ris IS NULL THEN close >= mid WHEN ris THEN close >= bot ELSE close > top END
      FROM (SELECT *, CASE WHEN k >= 14 THEN 100 * abs(wu / nullif(wa, 0) - wd / nullif(wa, 0)) / nullif(wu / nullif(wa, 0) + wd / nullif(wa, 0), 0) END AS dx
        FROM (SELECT p.symbol, p.k, p.date, p.close, p.mid, p.wide, (2 * p.close + 11 * x.e12) / 13 AS e12, (2 * p.close + 25 * x.e26) / 27 AS e26, (2 * p.close + 49 * x.e50) / 51 AS e50, (2 * p.close + 199 * x.e200) / 201 AS e200,
            x.sg, (p.tr + 13 * x.wa) / 14 AS wa, (p.up + 13 * x.wu) / 14 AS wu, (p.dn + 13 * x.wd) / 14 AS wd, x.ax, x.an, x.aw, x.ris,
            CASE WHEN p.wide IS NULL THEN x.top WHEN x.top IS NULL OR p.mid + p.wide < x.top OR p.pc > x.top THEN p.mid + p.wide ELSE x.top END AS top,
            CASE WHEN p.wide IS NULL THEN x.bot WHEN x.bot IS NULL OR p.mid - p.wide > x.bot OR p.pc < x.bot THEN p.mid - p.wide ELSE x.bot END AS bot
          FROM rec x JOIN p2 p ON p.symbol = x.symbol AND p.k = x.k + 1))),
    ri AS (SELECT symbol, date, e12 AS ema_12, e26 AS ema_26, e50 AS ema_50, e200 AS ema_200, e12 - e26 AS macd_line, sg AS macd_signal, e12 - e26 - sg AS macd_histogram, CASE WHEN k >= 14 THEN 100 * wu / nullif(wa, 0) END AS plus_di,
        CASE WHEN k >= 14 THEN 100 * wd / nullif(wa, 0) END AS minus_di, CASE WHEN an >= 14 THEN ax END AS adx_14, CASE WHEN ris THEN bot WHEN NOT ris THEN top END AS supertrend FROM rec)"""

MORE = f"""m1 AS (SELECT *, close / lag(close) OVER {W1} - 1 AS ret, close / max(close) OVER {W1} - 1 AS dd, coalesce(sign(close - lag(close) OVER {W1}) * volume, 0) AS flow, {full(20, 'close', 'avg(close)')} AS mean_20, {full(20, 'close', 'stddev_samp(close)')} AS sd_20 FROM prices),
    more AS (SELECT symbol, date, {full(30, 'ret', 'stddev_samp(ret)')} * sqrt(252) AS volatility_30, min(dd) OVER {W1} AS max_drawdown, sum(flow) OVER {W1} AS obv, volume / nullif({full(20, 'volume', 'avg(volume)')}, 0) AS volume_ratio_20,
        (close - (mean_20 - 2 * sd_20)) / nullif(4 * sd_20, 0) AS percent_b, mean_20 + 2 * sd_20 AS bollinger_upper, mean_20 - 2 * sd_20 AS bollinger_lower, 4 * sd_20 / nullif(mean_20, 0) AS bandwidth FROM m1)"""

LEVELS = """s1 AS (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 180),
    s2 AS (SELECT *, count(*) OVER v AS k, max(high) OVER v AS hi, min(low) OVER v AS lo, arg_max(close, date) OVER (PARTITION BY symbol) AS c FROM s1 WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    s3 AS (SELECT symbol, any_value(c) AS c, max(low) FILTER (WHERE k = 5 AND low = lo AND low <= c) AS support, min(high) FILTER (WHERE k = 5 AND high = hi AND high >= c) AS resistance FROM s2 GROUP BY symbol),
    levels AS (SELECT symbol, (c - support) / nullif(c, 0) * 100 AS support_percent, (resistance - c) / nullif(c, 0) * 100 AS resistance_percent FROM s3)"""

_SNAP = ("t.sma_50 t.sma_200 osc.rsi_14 ri.macd_line ri.macd_signal ri.plus_di ri.minus_di ri.adx_14 ri.supertrend osc.stochastic_k osc.stochastic_d osc.roc_12 osc.atr_14 more.volatility_30 more.max_drawdown more.obv more.volume_ratio_20").split()

TECH = f"""{REC}, {TREND}, {OSC}, {MORE}, {LEVELS},
    snap AS (SELECT osc.symbol, osc.date, osc.close, {', '.join(f'round({c}, 6) AS {c.split(".")[1]}' for c in _SNAP)}, support_percent, resistance_percent, coalesce(risk_level, 'medium') AS risk_level
        FROM osc JOIN t USING (symbol, date) JOIN more USING (symbol, date) JOIN ri USING (symbol, date) LEFT JOIN levels ON levels.symbol = osc.symbol LEFT JOIN assets ON assets.symbol = osc.symbol
        QUALIFY row_number() OVER (PARTITION BY osc.symbol ORDER BY osc.date DESC) = 1),
    sub AS (SELECT *,
        CASE WHEN close > sma_50 THEN 22 ELSE 0 END + CASE WHEN close > sma_200 THEN 22 ELSE 0 END + CASE WHEN sma_50 > sma_200 THEN 20 ELSE 0 END
          + CASE WHEN adx_14 >= 25 AND coalesce(plus_di, 0) > coalesce(minus_di, 0) THEN 18 WHEN adx_14 >= 25 AND coalesce(minus_di, 0) > coalesce(plus_di, 0) THEN 0 WHEN adx_14 IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN close > supertrend THEN 18 ELSE 0 END AS trend,
        CASE WHEN rsi_14 >= 40 AND rsi_14 <= 65 THEN 35 WHEN (rsi_14 >= 30 AND rsi_14 < 40) OR (rsi_14 > 65 AND rsi_14 <= 72) THEN 20 WHEN rsi_14 >= 70 THEN 8 WHEN rsi_14 <= 30 THEN 12 ELSE 0 END
          + CASE WHEN macd_line > macd_signal THEN 30 WHEN macd_line < macd_signal THEN 8 ELSE 0 END
          + CASE WHEN stochastic_k IS NULL OR stochastic_d IS NULL THEN 0 WHEN stochastic_k > stochastic_d AND stochastic_k < 80 THEN 18 WHEN stochastic_k > 85 THEN 6 ELSE 10 END + CASE WHEN roc_12 > 0 THEN 17 ELSE 0 END AS momentum,
        CASE WHEN volatility_30 < .2::DOUBLE THEN 45 WHEN volatility_30 < .4::DOUBLE THEN 32 WHEN volatility_30 IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN max_drawdown > -.18::DOUBLE THEN 35 WHEN max_drawdown > -.35::DOUBLE THEN 22 WHEN max_drawdown IS NOT NULL THEN 8 ELSE 0 END
          + CASE WHEN atr_14 / nullif(close, 0) < .025::DOUBLE THEN 20 WHEN atr_14 / nullif(close, 0) < .055::DOUBLE THEN 10 WHEN atr_14 IS NOT NULL AND close <> 0 THEN 4 ELSE 0 END AS volatility,
        45 + CASE WHEN volume_ratio_20 >= 1 AND volume_ratio_20 <= 2.5 THEN 35 WHEN volume_ratio_20 < .75 THEN 10 WHEN volume_ratio_20 IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN obv >= 0 THEN 20 WHEN obv < 0 THEN 8 ELSE 0 END AS vol_score,
        50 + CASE WHEN support_percent <= 3 THEN 25 WHEN support_percent <= 8 THEN 12 ELSE 0 END - CASE WHEN resistance_percent <= 3 THEN 25 WHEN resistance_percent <= 8 THEN 10 ELSE 0 END AS sr_score,
        CASE risk_level WHEN 'very_high' THEN 45 WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 0 END + CASE WHEN volatility_30 >= .45::DOUBLE THEN 25 ELSE 0 END + CASE WHEN max_drawdown <= -.35::DOUBLE THEN 25 ELSE 0 END + CASE WHEN resistance_percent <= 3 THEN 8 ELSE 0 END AS penalty
      FROM snap),
    tech AS (SELECT *, round(greatest(0, least(100, .3::DOUBLE * least(trend, 100) + .25::DOUBLE * least(momentum, 100) + .15::DOUBLE * least(volatility, 100) + .1::DOUBLE * least(vol_score, 100) + .1::DOUBLE * sr_score - .1::DOUBLE * least(penalty, 100))), 2) AS score,
        CASE WHEN volatility_30 >= .55::DOUBLE OR max_drawdown <= -.45::DOUBLE THEN 'HIGH' WHEN volatility_30 <= .18::DOUBLE AND max_drawdown > -.18::DOUBLE THEN CASE WHEN risk_level IN ('high', 'very_high') THEN 'MEDIUM' ELSE 'LOW' END
          WHEN risk_level IN ('high', 'very_high') THEN 'HIGH' WHEN risk_level = 'low' THEN 'LOW' ELSE 'MEDIUM' END AS computed_risk,
        list_count([sma_50, sma_200, rsi_14, macd_line, macd_signal, adx_14, atr_14, volume_ratio_20, volatility_30, max_drawdown]) / 10 AS there,
        coalesce(close > sma_50, FALSE)::INT + coalesce(close > sma_200, FALSE)::INT + coalesce(macd_line > macd_signal, FALSE)::INT + (NOT coalesce(volatility_30 >= .45::DOUBLE, FALSE))::INT AS votes,
        CASE WHEN close > sma_50 THEN 1 ELSE -1 END + CASE WHEN close > sma_200 THEN 1 ELSE -1 END + CASE WHEN macd_line > macd_signal THEN 1 WHEN macd_line < macd_signal THEN -1 ELSE 0 END - CASE WHEN volatility_30 >= .45::DOUBLE THEN 1 ELSE 0 END
          + CASE WHEN support_percent <= 3 THEN 1 ELSE 0 END - CASE WHEN resistance_percent <= 3 THEN 1 ELSE 0 END AS lean FROM sub)"""

AS_OF = "2000-10-01"


def _signal(x: str) -> str:
    return f"CASE WHEN {x} >= 80 THEN 'STRONG_BUY' WHEN {x} >= 70 THEN 'BUY' WHEN {x} >= 55 THEN 'HOLD' WHEN {x} >= 40 THEN 'REDUCE' WHEN {x} IS NOT NULL THEN 'SELL' END"


SIGNALS = f"""{TECH}, {NEWS}, n7 AS (SELECT symbol, count(*) AS news_count, round(avg(score), 4) AS mood, max(CASE impact WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS strong FROM scored WHERE published_at >= DATE '{AS_OF}' - 7 GROUP BY symbol),
    signals AS (SELECT symbol, tech.score AS technical_score, coalesce(news_count, 0) AS news_count, greatest(-5, least(5, coalesce(mood, 0) * 5)) AS moved, round(greatest(0, least(100, tech.score + greatest(-5, least(5, coalesce(mood, 0) * 5)))), 2) AS score,
        CASE WHEN coalesce(mood, 0) >= .15 THEN 'POSITIVE' WHEN coalesce(mood, 0) <= -.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS news_label, CASE strong WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS news_impact FROM tech LEFT JOIN n7 USING (symbol))"""


def snapshot(spark, sf, bars=None):
    """Of bars that are written once, as the indicators and the pivots both read them."""
    return indicators.snapshot(scratch.keep(views.prices(spark, sf), "bars") if bars is None else bars)


def technical_rows(spark, sf, bars=None):
    return scoring.technical(snapshot(spark, sf, bars), views.assets(spark, sf))


def signal_rows(spark, sf, bars=None):
    """Stored signals, written once: symbol, technical_score, score (final), signal and what the news say."""
    out = scoring.overlay(technical_rows(spark, sf, bars).select("symbol", "score"), _news(spark, sf), AS_OF)
    return scratch.keep(out.select("symbol", F.col("score").alias("technical_score"), "news_count", "news_score", F.col("final_score").alias("score"), F.col("final_signal").alias("signal"), "news_label", "news_impact"), "signals")


@query("recursive_indicators", f"WITH RECURSIVE {REC} SELECT symbol, date, " + ", ".join(f"round({n}, 3) AS {n}" for n in "ema_12 ema_26 ema_50 ema_200 macd_line macd_signal macd_histogram plus_di minus_di adx_14 supertrend".split()) + " FROM ri", "prices")
def recursive_indicators(spark, sf):
    return rounded(indicators.recursive(views.prices(spark, sf)), "symbol", "date", "ema_12", "ema_26", "ema_50", "ema_200", "macd_line", "macd_signal", "macd_histogram", "plus_di", "minus_di", "adx_14", "supertrend", digits=3)


@query("technical_score", f"""WITH RECURSIVE {TECH} SELECT symbol, date, close, trend::DOUBLE AS trend_score, momentum::DOUBLE AS momentum_score, volatility::DOUBLE AS volatility_score, vol_score::DOUBLE AS volume_score, sr_score::DOUBLE AS support_resistance_score, penalty::DOUBLE AS risk_penalty,
    score, {_signal('score')} AS signal, computed_risk, CASE WHEN there >= .85 AND greatest(votes, 4 - votes) / 4 >= .7 THEN 'HIGH' WHEN there >= .6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN lean + (adx_14 >= 25 AND lean > 0 AND adx_14 IS NOT NULL)::INT >= 3 THEN 'BULLISH' WHEN lean <= -3 THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias FROM tech""", "prices", "assets")
def technical_score(spark, sf):
    return technical_rows(spark, sf).select("symbol", "date", "close", *scoring.WEIGHTS, "score", "signal", "computed_risk", "confidence", "bias")


REASONS = """array_to_string(list_filter([
    CASE WHEN sma_50 IS NULL THEN 'neutral:NO_SMA50' WHEN close > sma_50 THEN 'positive:ABOVE_SMA50' ELSE 'negative:BELOW_SMA50' END, CASE WHEN sma_200 IS NULL THEN 'neutral:NO_SMA200' WHEN close > sma_200 THEN 'positive:ABOVE_SMA200' ELSE 'negative:BELOW_SMA200' END,
    CASE WHEN sma_50 > sma_200 THEN 'positive:SMA50_ABOVE_SMA200' WHEN sma_50 <= sma_200 THEN 'negative:SMA50_BELOW_SMA200' END,
    CASE WHEN adx_14 >= 25 AND plus_di > minus_di THEN 'positive:ADX_RISING' WHEN adx_14 >= 25 AND minus_di > plus_di THEN 'negative:ADX_FALLING' WHEN adx_14 IS NOT NULL THEN 'neutral:ADX_UNDIRECTED' END,
    CASE WHEN close > supertrend THEN 'positive:ABOVE_SUPERTREND' WHEN supertrend IS NOT NULL THEN 'negative:BELOW_SUPERTREND' END,
    CASE WHEN rsi_14 BETWEEN 40 AND 65 THEN 'positive:RSI_SOUND' WHEN rsi_14 BETWEEN 30 AND 72 THEN 'neutral:RSI_WATCH' WHEN rsi_14 > 72 THEN 'negative:RSI_OVERBOUGHT' WHEN rsi_14 < 30 THEN 'negative:RSI_OVERSOLD' END,
    CASE WHEN macd_line > macd_signal THEN 'positive:MACD_POSITIVE' WHEN macd_line < macd_signal THEN 'negative:MACD_NEGATIVE' END,
    CASE WHEN stochastic_d IS NULL THEN NULL WHEN stochastic_k > stochastic_d AND stochastic_k < 80 THEN 'positive:STOCHASTIC_SOUND' WHEN stochastic_k > 85 THEN 'negative:STOCHASTIC_STRETCHED' END,
    CASE WHEN roc_12 > 0 THEN 'positive:ROC_POSITIVE' WHEN roc_12 <= 0 THEN 'negative:ROC_NEGATIVE' END,
    CASE WHEN volatility_30 < .2 THEN 'positive:VOLATILITY_LOW' WHEN volatility_30 < .4 THEN 'neutral:VOLATILITY_MIDDLE' WHEN volatility_30 >= .4 THEN 'negative:VOLATILITY_HIGH' END,
    CASE WHEN max_drawdown > -.18 THEN 'positive:DRAWDOWN_LOW' WHEN max_drawdown > -.35 THEN 'neutral:DRAWDOWN_MIDDLE' WHEN max_drawdown <= -.35 THEN 'negative:DRAWDOWN_HIGH' END,
    CASE WHEN volume_ratio_20 BETWEEN 1 AND 2.5 THEN 'positive:VOLUME_CONFIRMS' WHEN volume_ratio_20 < .75 THEN 'negative:VOLUME_LOW' WHEN volume_ratio_20 IS NOT NULL THEN 'neutral:VOLUME_UNUSUAL' END,
    CASE WHEN support_percent <= 3 THEN 'positive:NEAR_SUPPORT' END, CASE WHEN resistance_percent <= 3 THEN 'negative:NEAR_RESISTANCE' END], lambda x: x IS NOT NULL), ',')"""


@query("score_reasons", f"WITH RECURSIVE {TECH} SELECT symbol, {REASONS} AS reasons FROM tech", "prices", "assets")
def score_reasons(spark, sf):
    said = F.transform("reasons", lambda x: F.concat(x.kind, F.lit(":"), x.code))
    return technical_rows(spark, sf).select("symbol", F.array_join(said, ",").alias("reasons"))


@query("technical_analysis", f"""WITH RECURSIVE {SIGNALS}, x AS (SELECT tech.*, signals.technical_score, signals.score AS final_score, signals.news_label, signals.news_impact FROM tech JOIN signals USING (symbol))
    SELECT symbol, coalesce(close > sma_50, FALSE) AS above_sma50, coalesce(close > sma_200, FALSE) AS above_sma200, coalesce(macd_line > macd_signal, FALSE) AS bullish_macd, coalesce(macd_line < macd_signal, FALSE) AS bearish_macd, coalesce(rsi_14 >= 70, FALSE) AS overbought,
    coalesce(rsi_14 <= 30, FALSE) AS oversold, coalesce(volatility_30 >= .45::DOUBLE, FALSE) AS high_volatility, coalesce(support_percent <= 3, FALSE) AS near_support, coalesce(resistance_percent <= 3, FALSE) AS near_resistance, technical_score, final_score, {_signal('technical_score')} AS signal, {_signal('final_score')} AS stored_signal, news_label, news_impact,
    CASE WHEN close > sma_50 AND close > sma_200 THEN 'Rising: the price is above its 50- and 200-bar averages.' WHEN coalesce(close <= sma_50, TRUE) AND coalesce(close <= sma_200, TRUE) THEN 'Weak: the price is below its main averages.' WHEN adx_14 >= 25 THEN 'Directed, says the ADX.' ELSE 'Mixed or sideways.' END AS trend_summary FROM x""", "prices", "assets", "news")
def technical_analysis(spark, sf):
    bars = scratch.keep(views.prices(spark, sf), "bars")
    rows = scratch.keep(technical_rows(spark, sf, bars), "technical")
    told = scoring.overlay(rows.select("symbol", "score"), _news(spark, sf), AS_OF)
    rows = rows.withColumnRenamed("score", "technical_score").join(told.select("symbol", "final_score", F.col("final_signal").alias("stored_signal"), "news_label", "news_impact"), "symbol")
    return rows.select(
        "symbol", "above_sma50", "above_sma200", "bullish_macd", "bearish_macd", "overbought", "oversold", "high_volatility", "near_support", "near_resistance",
        "technical_score", "final_score", "signal", "stored_signal", "news_label", "news_impact", "trend_summary",
    )


@query("signals", f"WITH RECURSIVE {SIGNALS} SELECT symbol, technical_score, news_count::BIGINT AS news_count, round(moved, 2)::DOUBLE AS news_score, score, {_signal('score')} AS signal, news_label, news_impact FROM signals", "prices", "assets", "news")
def signals(spark, sf):
    return signal_rows(spark, sf)


@query("price_view", f"""WITH RECURSIVE {REC}, {TREND}, {OSC}, {MORE} SELECT osc.symbol, osc.date, osc.open, osc.high, osc.low, osc.close, round(osc.volume, 2) AS volume, {', '.join(f'round({c}, {5 if "sma" in c else 3}) AS {c.split(".")[1]}' for c in 't.sma_20 t.sma_50 t.sma_200 ri.ema_12 ri.ema_26 ri.ema_50 ri.ema_200 osc.rsi_14 ri.macd_line ri.macd_signal ri.macd_histogram more.bollinger_upper more.bollinger_lower more.bandwidth'.split())}
    FROM osc JOIN t USING (symbol, date) JOIN more USING (symbol, date) JOIN ri USING (symbol, date)""", "prices")
def price_view(spark, sf):
    """Bars with the indicators that a chart shows."""
    rows = indicators.bands(indicators.oscillators(indicators.trend(indicators.averages(views.prices(spark, sf)))))
    names = "sma_20 sma_50 sma_200 ema_12 ema_26 ema_50 ema_200 rsi_14 macd_line macd_signal macd_histogram bollinger_upper bollinger_lower bandwidth".split()
    return rows.select("symbol", "date", "open", "high", "low", "close", F.round("volume", 2).alias("volume"), *[F.round(n, 5 if n.startswith("sma") else 3).alias(n) for n in names])


@query("snapshot_lines", f"""WITH m AS (SELECT *, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS b FROM prices), n AS (SELECT *, lag((tenkan + kijun) / 2, 26) OVER {W1} AS senkou_a, lag(b, 26) OVER {W1} AS senkou_b, lead(close, 26) OVER {W1} AS chikou FROM m)
    SELECT symbol, date, {', '.join(f'round({c}, 4) AS {c}' for c in 'tenkan kijun senkou_a senkou_b chikou'.split())} FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""", "prices")
def snapshot_lines(spark, sf):
    """The latest snapshot's cloud."""
    return snapshot(spark, sf).select("symbol", "date", *[F.round(c, 4).alias(c) for c in ("tenkan", "kijun", "senkou_a", "senkou_b", "chikou")])


ROLLING = f"""{REC}, {TREND}, {OSC}, {MORE}, rolling AS (SELECT osc.symbol, osc.date, osc.close, round(greatest(0, least(100, 50::DOUBLE
    + CASE WHEN osc.close > sma_50 THEN 10 WHEN sma_50 IS NOT NULL THEN -10 ELSE 0 END + CASE WHEN osc.close > sma_200 THEN 12 WHEN sma_200 IS NOT NULL THEN -12 ELSE 0 END + CASE WHEN sma_50 > sma_200 THEN 8 WHEN sma_200 IS NOT NULL THEN -8 ELSE 0 END
    + CASE WHEN rsi_14 >= 45 AND rsi_14 <= 65 THEN 10 WHEN (rsi_14 >= 35 AND rsi_14 < 45) OR (rsi_14 > 65 AND rsi_14 <= 72) THEN 4 WHEN rsi_14 > 78 THEN -12 WHEN rsi_14 < 30 THEN -6 ELSE 0 END
    + CASE WHEN macd_line > macd_signal THEN 8 ELSE -8 END + CASE WHEN volatility_30 < .18::DOUBLE THEN 5 WHEN volatility_30 > .45::DOUBLE THEN -10 ELSE 0 END + CASE WHEN max_drawdown < -.25::DOUBLE THEN -8 ELSE 0 END)), 2) AS score
    FROM osc JOIN t USING (symbol, date) JOIN more USING (symbol, date) JOIN ri USING (symbol, date))"""


def scores(spark, sf):
    return indicators.rolling_score(views.prices(spark, sf))


@query("rolling_score_signal", f"WITH RECURSIVE {ROLLING} SELECT symbol, date, close, score, {_signal('score')} AS signal FROM rolling", "prices")
def rolling_score_signal(spark, sf):
    return rounded(scores(spark, sf), "symbol", "date", "close", "score", "signal")


@query("top_n_by_score", f"WITH RECURSIVE {ROLLING} SELECT date, (row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol))::INT AS place, symbol, score, {_signal('score')} AS signal FROM rolling QUALIFY place <= 3", "prices")
def top_n_by_score(spark, sf):
    best = W.partitionBy("date").orderBy(F.desc("score"), "symbol")
    return scores(spark, sf).withColumn("place", F.row_number().over(best)).where("place <= 3").select("date", "place", "symbol", "score", "signal")


__all__ = ["signal_rows", "technical_rows", "r"]
