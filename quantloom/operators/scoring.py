"""Technical score of a symbol's latest snapshot: six sub-scores, the weighted score, its reasons, risk level, confidence and bias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import clamp, signal_of

#: What each sub-score weighs.
WEIGHTS = {"trend_score": 0.30, "momentum_score": 0.25, "volatility_score": 0.15, "volume_score": 0.10, "support_resistance_score": 0.10, "risk_penalty": -0.10}
#: Fixed value: points that the mean sentiment of -1 to 1 can move a score by.
NEWS_WEIGHT = 5.0
#: What confidence asks to be there.
REQUIRED = ("sma_50", "sma_200", "rsi_14", "macd_line", "macd_signal", "adx_14", "atr_14", "volume_ratio_20", "volatility_30", "max_drawdown")


def _first(*cases: tuple[Column, float], rest: float = 0.0) -> Column:
    """The number of the first case that holds; a condition on a missing value doesn't."""
    out = F.when(cases[0][0], cases[0][1])
    for cond, x in cases[1:]:
        out = out.when(cond, x)
    return out.otherwise(rest)


def sub_scores() -> dict[str, Column]:
    c = F.col
    close, rsi, k, d = c("close"), c("rsi_14"), c("stochastic_k"), c("stochastic_d")
    vol, fall, ratio, risk = c("volatility_30"), c("max_drawdown"), c("volume_ratio_20"), F.lower("risk_level")
    plus, minus, strong = F.coalesce("plus_di", F.lit(0.0)), F.coalesce("minus_di", F.lit(0.0)), c("adx_14") >= 25
    atr = F.when(close != 0, c("atr_14") / close)
    trend = (
        _first((close > c("sma_50"), 22)) + _first((close > c("sma_200"), 22)) + _first((c("sma_50") > c("sma_200"), 20))
        + _first((strong & (plus > minus), 18), (strong & (minus > plus), 0), (c("adx_14").isNotNull(), 8)) + _first((close > c("supertrend"), 18))
    )
    momentum = (
        _first((rsi.between(40, 65), 35), (rsi.between(30, 72), 20), (rsi >= 70, 8), (rsi <= 30, 12)) + _first((c("bullish_macd"), 30), (c("bearish_macd"), 8))
        + _first(((k > d) & (k < 80), 18), (d.isNotNull() & (k > 85), 6), (k.isNotNull() & d.isNotNull(), 10)) + _first((c("roc_12") > 0, 17))
    )
    volatility = (
        _first((vol < 0.20, 45), (vol < 0.40, 32), (vol.isNotNull(), 12)) + _first((fall > -0.18, 35), (fall > -0.35, 22), (fall.isNotNull(), 8))
        + _first((atr < 0.025, 20), (atr < 0.055, 10), (atr.isNotNull(), 4))
    )
    volume = 45 + _first((ratio.between(1.0, 2.5), 35), (ratio < 0.75, 10), (ratio.isNotNull(), 20)) + _first((c("obv") >= 0, 20), (c("obv").isNotNull(), 8))
    levels = 50 + _first((c("support_percent") <= 3, 25), (c("support_percent") <= 8, 12)) - _first((c("resistance_percent") <= 3, 25), (c("resistance_percent") <= 8, 10))
    penalty = _first((risk == "very_high", 45), (risk == "high", 30), (risk == "medium", 15)) + _first((vol >= 0.45, 25)) + _first((fall <= -0.35, 25)) + _first((c("near_resistance"), 8))
    raw = {"trend_score": trend, "momentum_score": momentum, "volatility_score": volatility, "volume_score": volume, "support_resistance_score": levels, "risk_penalty": penalty}
    return {n: F.round(clamp(x.cast("double")), 2) for n, x in raw.items()}


def reasons() -> Column:
    """array<struct<kind, code>> of all that speaks for or against, in a fixed order."""
    c = F.col
    close, rsi, vol, fall, ratio = c("close"), c("rsi_14"), c("volatility_30"), c("max_drawdown"), c("volume_ratio_20")
    strong, plus, minus = c("adx_14") >= 25, F.coalesce("plus_di", F.lit(0.0)), F.coalesce("minus_di", F.lit(0.0))
    say = lambda *cases: _chain([(cond, F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"))) for cond, kind, code in cases])
    found = [
        say((c("sma_50").isNull(), "neutral", "NO_SMA50"), (c("above_sma50"), "positive", "ABOVE_SMA50"), (F.lit(True), "negative", "BELOW_SMA50")),
        say((c("sma_200").isNull(), "neutral", "NO_SMA200"), (c("above_sma200"), "positive", "ABOVE_SMA200"), (F.lit(True), "negative", "BELOW_SMA200")),
        say((c("sma_50") > c("sma_200"), "positive", "SMA50_ABOVE_SMA200"), (c("sma_50") <= c("sma_200"), "negative", "SMA50_BELOW_SMA200")),
        say((strong & (plus > minus), "positive", "ADX_RISING"), (strong & (minus > plus), "negative", "ADX_FALLING"), (c("adx_14").isNotNull(), "neutral", "ADX_UNDIRECTED")),
        say((close > c("supertrend"), "positive", "ABOVE_SUPERTREND"), (close <= c("supertrend"), "negative", "BELOW_SUPERTREND")),
        say((rsi.between(40, 65), "positive", "RSI_SOUND"), (rsi.between(30, 72), "neutral", "RSI_WATCH"), (rsi >= 70, "negative", "RSI_OVERBOUGHT"), (rsi <= 30, "negative", "RSI_OVERSOLD")),
        say((c("bullish_macd"), "positive", "MACD_POSITIVE"), (c("bearish_macd"), "negative", "MACD_NEGATIVE")),
        say((c("stochastic_d").isNull(), None, None), ((c("stochastic_k") > c("stochastic_d")) & (c("stochastic_k") < 80), "positive", "STOCHASTIC_SOUND"), (c("stochastic_k") > 85, "negative", "STOCHASTIC_STRETCHED")),
        say((c("roc_12") > 0, "positive", "ROC_POSITIVE"), (c("roc_12") <= 0, "negative", "ROC_NEGATIVE")),
        say((vol < 0.20, "positive", "VOLATILITY_LOW"), (vol < 0.40, "neutral", "VOLATILITY_MIDDLE"), (vol >= 0.40, "negative", "VOLATILITY_HIGH")),
        say((fall > -0.18, "positive", "DRAWDOWN_LOW"), (fall > -0.35, "neutral", "DRAWDOWN_MIDDLE"), (fall <= -0.35, "negative", "DRAWDOWN_HIGH")),
        say((ratio.between(1.0, 2.5), "positive", "VOLUME_CONFIRMS"), (ratio < 0.75, "negative", "VOLUME_LOW"), (ratio.isNotNull(), "neutral", "VOLUME_UNUSUAL")),
        say((c("support_percent") <= 3, "positive", "NEAR_SUPPORT")), say((c("resistance_percent") <= 3, "negative", "NEAR_RESISTANCE")),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull() & x.code.isNotNull())


def _chain(cases: list) -> Column:
    out = F.when(*cases[0])
    for cond, x in cases[1:]:
        out = out.when(cond, x)
    return out


def risk_of() -> Column:
    risk, vol, fall = F.lower("risk_level"), F.col("volatility_30"), F.col("max_drawdown")
    base = F.when(risk.isin("high", "very_high"), "HIGH").when(risk == "low", "LOW").otherwise("MEDIUM")
    calm = (vol <= 0.18) & (fall > -0.18)
    return F.when((vol >= 0.55) | (fall <= -0.45), "HIGH").when(calm & (base == "HIGH"), "MEDIUM").when(calm, "LOW").otherwise(base)


def confidence() -> Column:
    there = sum((F.col(n).isNotNull().cast("int") for n in REQUIRED), F.lit(0)) / len(REQUIRED)
    votes = sum((x.cast("int") for x in (F.col("above_sma50"), F.col("above_sma200"), F.col("bullish_macd"), ~F.col("high_volatility"))), F.lit(0))
    agree = F.greatest(votes, 4 - votes) / 4
    return F.when((there >= 0.85) & (agree >= 0.70), "HIGH").when(there >= 0.60, "MEDIUM").otherwise("LOW")


def bias() -> Column:
    c = F.col
    sign = lambda cond: F.when(cond, 1).otherwise(-1)
    votes = sign(c("above_sma50")) + sign(c("above_sma200")) + _first((c("bullish_macd"), 1), (c("bearish_macd"), -1)) - c("high_volatility").cast("int") + c("near_support").cast("int") - c("near_resistance").cast("int")
    votes = votes + F.when((c("adx_14") >= 25) & (votes > 0), 1).otherwise(0)
    return F.when(votes >= 3, "BULLISH").when(votes <= -3, "BEARISH").otherwise("NEUTRAL")


def summaries() -> dict[str, Column]:
    """One sentence each on trend, momentum, volatility and volume."""
    c = F.col
    up50, up200, percent = c("above_sma50"), c("above_sma200"), F.format_string("%.1f%%", c("volatility_30") * 100)
    return {
        "trend_summary": F.when(up50 & up200, "Rising: the price is above its 50- and 200-bar averages.").when(~up50 & ~up200, "Weak: the price is below its main averages.").when(c("adx_14") >= 25, "Directed, says the ADX.").otherwise("Mixed or sideways."),
        "momentum_summary": F.when(c("bullish_macd") & c("rsi_14").between(40, 65), "Building: positive MACD, sound RSI.").when(c("overbought"), "Strong, but the RSI is overbought.").when(c("oversold"), "Weak, but the RSI is oversold.").when(c("bearish_macd"), "Frail: the MACD is below its signal.").otherwise("Neutral."),
        "volatility_summary": F.when(c("high_volatility"), F.concat(F.lit("High: "), percent, F.lit("."))).when(c("volatility_30").isNotNull(), F.concat(F.lit("30 bars, annualised: "), percent, F.lit("."))).otherwise("Unknown."),
        "volume_summary": F.when(c("volume_ratio_20").isNull(), "Unknown.").when(c("volume_ratio_20") >= 1.5, "Above average.").when(c("volume_ratio_20") <= 0.7, "Below average.").otherwise("About average."),
    }


def technical(snapshot: DataFrame, assets: DataFrame) -> DataFrame:
    """The snapshot with sub-scores, score, signal, computed_risk, confidence, bias, reasons and summaries."""
    out = snapshot.join(assets.select("symbol", "risk_level"), "symbol", "left").withColumn("risk_level", F.coalesce("risk_level", F.lit("medium")))
    out = out.withColumns(sub_scores())
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("score", F.round(clamp(total), 2))
    return out.withColumns({"signal": signal_of(F.col("score")), "computed_risk": risk_of(), "confidence": confidence(), "bias": bias(), "reasons": reasons(), **summaries()})


def overlay(scored: DataFrame, news: DataFrame, as_of: str, days: int = 7, weight: float = NEWS_WEIGHT) -> DataFrame:
    """Scores (symbol, score) moved by the mean sentiment of a symbol's news since ``days`` before ``as_of``, with news_score, final_score, final_signal, label and impact.

    Undated news and news of the future count."""
    recent = news.where(F.col("published_at").isNull() | (F.col("published_at") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    rank = F.when(F.col("impact") == "HIGH", 3).when(F.col("impact") == "MEDIUM", 2).otherwise(1)
    rows = recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("news_count"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 4).alias("sentiment"), F.max(rank).alias("__r"))
    rows = rows.withColumn("news_impact", F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), F.col("__r"))).drop("__r")
    out = scored.join(rows, "symbol", "left")
    news_score = F.greatest(F.lit(-weight), F.least(F.lit(weight), F.coalesce("sentiment", F.lit(0.0)) * weight))
    mood = F.coalesce("sentiment", F.lit(0.0))
    out = out.withColumns({
        "news_count": F.coalesce("news_count", F.lit(0).cast("long")), "news_score": F.round(news_score, 2), "final_score": F.round(clamp(F.col("score") + news_score), 2),
        "news_label": F.when(mood >= 0.15, "POSITIVE").when(mood <= -0.15, "NEGATIVE").otherwise("NEUTRAL"), "news_impact": F.coalesce("news_impact", F.lit("LOW")),
    })
    return out.withColumn("final_signal", signal_of(F.col("final_score"))).drop("sentiment")
