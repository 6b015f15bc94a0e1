"""Technical indicators of bars (symbol, date, open, high, low, close, volume) as window columns.

All windows share one partitioning and order, so that Spark plans one exchange and sort.
A moving value is NULL until its window is full; division by 0 gives NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.numeric import clamp, divide, finite, flag, signal_of


def by():
    return W.partitionBy("symbol").orderBy("date")


def so_far():
    return by().rowsBetween(W.unboundedPreceding, 0)


def last(n: int):
    return by().rowsBetween(1 - n, 0)


def full(x: Column, n: int, value: Column) -> Column:
    """``value`` over the last n rows where all have ``x``."""
    return F.when(F.count(x).over(last(n)) == n, value.over(last(n)))


def sma(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x))


def prepare(rows: DataFrame) -> DataFrame:
    """Bars as indicators need them: typed, without null keys or closes, gaps filled from the close.

    A missing open, high or low column or value follows from open and close, a missing volume is 0.
    Of several rows of a symbol and date, real ones come first, then the highest id (is_real and id, where there are such columns)."""
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)") if c in rows.columns else F.lit(None).cast("double")
    close, opened = F.col("close"), F.coalesce("open", "close")
    out = rows.withColumns({c: finite(number(c)) for c in ("open", "high", "low", "close", "volume")}).withColumn("date", F.expr("try_cast(`date` AS date)"))
    out = out.where("symbol IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL")
    first = [F.desc(F.coalesce(F.col(c), F.lit(v))) for c, v in (("is_real", False), ("id", -1)) if c in rows.columns] or [F.desc("close")]
    out = out.withColumn("__k", F.row_number().over(W.partitionBy("symbol", "date").orderBy(*first))).where("__k = 1")
    return out.select(
        "symbol", "date", opened.alias("open"), F.coalesce("high", F.greatest(opened, close)).alias("high"), F.coalesce("low", F.least(opened, close)).alias("low"),
        "close", F.coalesce("volume", F.lit(0.0)).alias("volume"),
    )


def trend(bars: DataFrame) -> DataFrame:
    """Simple averages of 10 to 200 bars, crosses of the 50- and 200-bar ones."""
    out = bars.withColumns({f"sma_{n}": sma(F.col("close"), n) for n in (10, 20, 50, 100, 200)})
    out = out.withColumns({"__a": F.lag("sma_50").over(by()), "__b": F.lag("sma_200").over(by())})
    a, b = F.col("sma_50"), F.col("sma_200")
    return out.withColumns({"golden_cross": flag((F.col("__a") <= F.col("__b")) & (a > b)), "death_cross": flag((F.col("__a") >= F.col("__b")) & (a < b))}).drop("__a", "__b")


def oscillators(bars: DataFrame) -> DataFrame:
    """rsi_14 (simple means), stochastic_k and _d, roc_12, atr_14."""
    c, move = F.col("close"), F.col("close") - F.lag("close").over(by())
    out = bars.withColumns({"__up": F.greatest(move, F.lit(0.0)), "__down": F.greatest(-move, F.lit(0.0)), "__before": F.lag("close").over(by())})
    out = out.withColumns({"__up": F.when(F.col("__before").isNotNull(), F.col("__up")), "__down": F.when(F.col("__before").isNotNull(), F.col("__down"))})
    gain, loss = sma(F.col("__up"), 14), sma(F.col("__down"), 14)
    rng = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__before")), F.abs(F.col("low") - F.col("__before")))
    lo, hi = full(F.col("low"), 14, F.min("low")), full(F.col("high"), 14, F.max("high"))
    out = out.withColumns({"__gain": gain, "__loss": loss, "__tr": rng, "stochastic_k": divide((c - lo) * 100, hi - lo), "roc_12": (divide(c, F.lag("close", 12).over(by())) - 1) * 100})
    rsi = F.when((F.col("__loss") == 0) & (F.col("__gain") > 0), 100.0).otherwise(100 - 100 / (1 + divide(F.col("__gain"), F.col("__loss"))))
    out = out.withColumns({"rsi_14": rsi, "atr_14": sma(F.col("__tr"), 14), "stochastic_d": sma(F.col("stochastic_k"), 3)})
    return out.drop("__up", "__down", "__before", "__gain", "__loss", "__tr")


def bands(bars: DataFrame) -> DataFrame:
    """Bollinger bands, cci_20 and the annualised volatility of 30 returns."""
    c = F.col("close")
    out = bars.withColumns({"__tp": (F.col("high") + F.col("low") + c) / 3, "__ret": divide(c, F.lag("close").over(by())) - 1, "bollinger_middle": sma(c, 20), "__sd": full(c, 20, F.stddev_samp("close"))})
    out = out.withColumns({"__tps": F.collect_list("__tp").over(last(20)), "__mean": sma(F.col("__tp"), 20), "volatility_30": full(F.col("__ret"), 30, F.stddev_samp("__ret")) * (252**0.5)})
    spread = F.aggregate("__tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("__mean"))) / 20
    up, down = F.col("bollinger_middle") + 2 * F.col("__sd"), F.col("bollinger_middle") - 2 * F.col("__sd")
    return out.withColumns({"bollinger_upper": up, "bollinger_lower": down, "percent_b": divide(c - down, up - down), "bandwidth": divide(up - down, F.col("bollinger_middle")), "cci_20": divide(F.col("__tp") - F.col("__mean"), 0.015 * spread)}).drop("__tp", "__ret", "__sd", "__tps", "__mean")


def drawdowns(bars: DataFrame) -> DataFrame:
    out = bars.withColumn("drawdown", divide(F.col("close"), F.max("close").over(so_far())) - 1)
    return out.withColumn("max_drawdown", F.min("drawdown").over(so_far()))


def cloud_and_volume(bars: DataFrame) -> DataFrame:
    """Ichimoku lines (chikou looks ahead: no feature), on-balance volume, volume ratio."""
    mid = lambda n: (full(F.col("high"), n, F.max("high")) + full(F.col("low"), n, F.min("low"))) / 2
    move = F.col("close") - F.lag("close").over(by())
    out = bars.withColumns({"tenkan": mid(9), "kijun": mid(26), "__b": mid(52), "chikou": F.lead("close", 26).over(by()), "__flow": F.coalesce(F.signum(move) * F.col("volume"), F.lit(0.0)), "volume_sma_20": sma(F.col("volume"), 20)})
    return out.withColumns({
        "senkou_a": F.lag((F.col("tenkan") + F.col("kijun")) / 2, 26).over(by()), "senkou_b": F.lag("__b", 26).over(by()),
        "obv": F.sum("__flow").over(so_far()), "volume_ratio_20": divide(F.col("volume"), F.col("volume_sma_20")),
    }).drop("__b", "__flow")


def pivots(bars: DataFrame, rows: int = 180) -> DataFrame:
    """Nearest support and resistance of each symbol from pivots of its latest rows."""
    late = W.partitionBy("symbol").orderBy(F.desc("date"))
    near = by().rowsBetween(-2, 2)
    out = bars.withColumn("__back", F.row_number().over(late)).where(F.col("__back") <= rows)
    out = out.withColumns({"__n": F.count(F.lit(1)).over(near), "__hi": F.max("high").over(near), "__lo": F.min("low").over(near), "__last": F.first("close").over(late.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    inner = F.col("__n") == 5
    low, high = inner & (F.col("low") == F.col("__lo")) & (F.col("low") <= F.col("__last")), inner & (F.col("high") == F.col("__hi")) & (F.col("high") >= F.col("__last"))
    out = out.groupBy("symbol").agg(F.first("__last").alias("close"), F.max(F.when(low, F.col("low"))).alias("support"), F.min(F.when(high, F.col("high"))).alias("resistance"))
    return out.withColumns({"support_percent": divide(F.col("close") - F.col("support"), F.col("close")) * 100, "resistance_percent": divide(F.col("resistance") - F.col("close"), F.col("close")) * 100})


#: Powers of e that a block of a recurrence decays by; what lies before the last whole block weighs less than a double's last digit.
DECAY = 40.0


def decayed(rows: DataFrame, least: int = 1, gaps: bool = False, **wanted: tuple[str, float]) -> DataFrame:
    """``rows`` with y = (1 - alpha) y before + alpha x for each wanted y=(x, alpha), from the first x on; NULL until ``least`` values are there.

    Steps y = a y + b compose, and y is the sum of all b, each times the product of the later a. Rows are cut into blocks
    over which that product falls by e^DECAY; a block's running sum of b over its decay so far, plus the total of the block
    before, gives y without going row by row, and neither overflows however long the series. ``gaps``: x may be NULL,
    y stays there while its weight goes on decaying."""
    c, made = F.col, {}
    rows = rows.withColumn("__t", F.row_number().over(by()))
    if gaps:  # what the old value weighs, against alpha
        before = lambda x: F.last(F.when(c(x).isNotNull(), c("__t")), True).over(by().rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumns({f"__w_{y}": F.pow(F.lit(1 - alpha), c("__t") - before(x)) for y, (x, alpha) in wanted.items()})
    for y, (x, alpha) in wanted.items():
        if gaps:
            w = c(f"__w_{y}")
            step = F.when(c(x).isNotNull() & w.isNotNull(), F.least(F.log1p(divide(F.lit(alpha), w)), F.lit(1e3)))
            fallen = F.coalesce(F.sum(step).over(so_far()), F.lit(0.0))
            b = F.coalesce(F.when(w.isNull(), c(x)).otherwise(alpha * c(x) / (w + alpha)), F.lit(0.0))
        else:
            fallen, b = (c("__t") - 1) * -math.log(1 - alpha), F.when(c("__t") == 1, c(x)).otherwise(alpha * c(x))
        made[y] = fallen, b
    rows = rows.withColumns({f"__l_{y}": fallen for y, (fallen, _) in made.items()})
    block = {y: F.floor(c(f"__l_{y}") / DECAY) for y in wanted}
    rows = rows.withColumns({f"__m_{y}": m for y, m in block.items()} | {f"__e_{y}": F.exp(m * DECAY - c(f"__l_{y}")) for y, m in block.items()})
    rows = rows.withColumns({f"__b_{y}": b / c(f"__e_{y}") for y, (_, b) in made.items()})
    values = {}
    for y, (x, _) in wanted.items():
        own = F.sum(f"__b_{y}").over(W.partitionBy("symbol", f"__m_{y}").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
        past = F.sum(f"__b_{y}").over(W.partitionBy("symbol").orderBy(f"__m_{y}").rangeBetween(-1, -1))
        value = c(f"__e_{y}") * (own + F.coalesce(past, F.lit(0.0)) * math.exp(-DECAY))
        values[y] = F.when(F.count(x).over(so_far()) >= least, value) if least > 1 or gaps else value
    return rows.withColumns(values).drop("__t", *[f"__{k}_{y}" for k in "wlmeb" for y in wanted])


def averages(bars: DataFrame) -> DataFrame:
    """EMA 12, 26, 50, 200 and MACD."""
    bars = decayed(bars, **{f"ema_{n}": ("close", 2 / (n + 1)) for n in (12, 26, 50, 200)})
    bars = decayed(bars.withColumn("macd_line", F.col("ema_12") - F.col("ema_26")), macd_signal=("macd_line", 2 / 10))
    return bars.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))


def directions(bars: DataFrame) -> DataFrame:
    """plus_di, minus_di and adx_14 by Wilder's averages."""
    c, was = F.col, lambda x: F.lag(x).over(by())
    up, down = c("high") - was("high"), was("low") - c("low")
    out = bars.withColumns({
        "__tr": F.greatest(c("high") - c("low"), F.abs(c("high") - was("close")), F.abs(c("low") - was("close"))),
        "__up": F.when((up > down) & (up > 0), up).otherwise(0.0), "__down": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    out = decayed(out, 14, **{f"__{x}_14": (f"__{x}", 1 / 14) for x in ("tr", "up", "down")})
    out = out.withColumns({"plus_di": divide(100 * c("__up_14"), c("__tr_14")), "minus_di": divide(100 * c("__down_14"), c("__tr_14"))})
    out = out.withColumn("__dx", divide(100 * F.abs(c("plus_di") - c("minus_di")), c("plus_di") + c("minus_di")))
    return decayed(out, 14, gaps=True, adx_14=("__dx", 1 / 14)).drop("__tr", "__up", "__down", "__tr_14", "__up_14", "__down_14", "__dx")


def supertrend(bars: DataFrame) -> DataFrame:
    """Bars with supertrend, whose bands depend on which side the price was on: one Arrow pass a symbol."""

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("date", ignore_index=True)
        c, h, lo = pdf["close"], pdf["high"], pdf["low"]
        tr = np.fmax(h - lo, np.fmax((h - c.shift()).abs(), (lo - c.shift()).abs()))
        band, mid = 3 * tr.rolling(10).mean(), (h + lo) / 2
        line, top, bottom, rising = np.full(len(pdf), np.nan), np.nan, np.nan, None
        for i, (price, m, b) in enumerate(zip(c, mid, band)):
            if np.isnan(b):
                continue
            before = c[i - 1] if i else price
            top = m + b if np.isnan(top) or m + b < top or before > top else top
            bottom = m - b if np.isnan(bottom) or m - b > bottom or before < bottom else bottom
            rising = price >= m if rising is None else (price >= bottom if rising else price > top)
            line[i] = bottom if rising else top
        pdf["supertrend"] = line
        return pdf.replace({np.nan: None})[names]

    names = ["symbol", "date", "open", "high", "low", "close", "volume", "supertrend"]
    schema = "symbol string, date date, " + ", ".join(f"{n} double" for n in names[2:])
    return bars.select(*names[:7]).groupBy("symbol").applyInPandas(run, schema)


def recursive(bars: DataFrame) -> DataFrame:
    """EMA 12, 26, 50, 200, MACD, ADX and Supertrend, which alone goes through Python."""
    return directions(averages(supertrend(bars)))


def enriched(bars: DataFrame) -> DataFrame:
    """Bars with all indicators: one exchange by symbol, the pass through Python first."""
    return cloud_and_volume(drawdowns(bands(oscillators(trend(recursive(bars))))))


#: What a snapshot holds besides close, support and resistance.
SNAPSHOT = (
    "sma_10 sma_20 sma_50 sma_100 sma_200 ema_12 ema_26 ema_50 ema_200 rsi_14 macd_line macd_signal macd_histogram stochastic_k stochastic_d cci_20 roc_12 bollinger_upper bollinger_middle "
    "bollinger_lower bandwidth percent_b atr_14 volatility_30 max_drawdown adx_14 plus_di minus_di supertrend tenkan kijun senkou_a senkou_b chikou obv volume_sma_20 volume_ratio_20"
).split()


def snapshot(bars: DataFrame) -> DataFrame:
    """Each symbol's latest row of all indicators to 6 digits, nearest pivots, and the conditions that rules ask for (missing: false)."""
    every = enriched(bars)
    first = W.partitionBy("symbol").orderBy(F.desc("date"))
    top = every.withColumn("__k", F.row_number().over(first)).where("__k = 1")
    top = top.select("symbol", "date", "close", *[F.round(c, 6).alias(c) for c in SNAPSHOT], "golden_cross", "death_cross")
    top = top.join(pivots(bars).drop("close"), "symbol", "left")
    c = F.col
    return top.withColumns({
        "above_sma50": flag(c("close") > c("sma_50")), "above_sma200": flag(c("close") > c("sma_200")), "bullish_macd": flag(c("macd_line") > c("macd_signal")), "bearish_macd": flag(c("macd_line") < c("macd_signal")),
        "overbought": flag(c("rsi_14") >= 70), "oversold": flag(c("rsi_14") <= 30), "high_volatility": flag(c("volatility_30") >= 0.45), "near_support": flag(c("support_percent") <= 3), "near_resistance": flag(c("resistance_percent") <= 3),
    })


def features(bars: DataFrame) -> DataFrame:
    """Features of every bar for models: returns, distances, and sub-scores of their own kind, from what is known at that bar."""
    c = F.col
    out = enriched(bars)
    before = lambda n: divide(c("close"), F.lag("close", n).over(by())) - 1
    recent = F.when(F.count("close").over(last(60)) >= 20, F.max("close").over(last(60)))
    out = out.withColumns({
        "return_1": before(1), "return_5": before(5), "return_20": before(20), "price_vs_sma50": divide(c("close"), c("sma_50")) - 1, "price_vs_sma200": divide(c("close"), c("sma_200")) - 1,
        "sma50_vs_sma200": divide(c("sma_50"), c("sma_200")) - 1, "max_drawdown_recent": divide(c("close"), recent) - 1,
    })
    yes = lambda cond, x: F.when(cond, float(x)).otherwise(0.0)
    within = lambda x: clamp(x.cast("double"))
    vol, fall = c("volatility_30"), c("max_drawdown_recent")
    ratio = F.greatest(F.least(F.coalesce("volume_ratio_20", F.lit(1.0)) - 1, F.lit(1.0)), F.lit(-1.0))
    out = out.withColumns({
        "trend_score": within(30 + yes(c("price_vs_sma50") > 0, 25) + yes(c("price_vs_sma200") > 0, 25) + yes(c("sma50_vs_sma200") > 0, 20)),
        "momentum_score": within(45 + yes(c("rsi_14").between(40, 65), 25) + yes(c("macd_histogram") > 0, 20) + yes(c("roc_12") > 0, 10) - yes((c("rsi_14") > 75) | (c("rsi_14") < 25), 20)),
        "volatility_score": within(100 - F.coalesce(vol, F.lit(0.3)) * 100 + F.coalesce(fall, F.lit(-0.2)) * 80),
        "volume_score": within(50 + ratio * 25), "support_resistance_score": within(65 - F.abs(F.coalesce("percent_b", F.lit(0.5)) - 0.5) * 45),
        "risk_penalty": within(F.coalesce(vol, F.lit(0.25)) * 55 + F.abs(F.coalesce(fall, F.lit(-0.15))) * 120),
    })
    total = c("trend_score") * 0.3 + c("momentum_score") * 0.25 + c("volatility_score") * 0.15 + c("volume_score") * 0.1 + c("support_resistance_score") * 0.1 - c("risk_penalty") * 0.1
    return out.withColumn("technical_score", within(total))


def rolling_score(bars: DataFrame) -> DataFrame:
    """score 0 to 100 of every bar from what is known at that bar, and its signal."""
    out = drawdowns(bands(oscillators(trend(averages(bars)))))
    c, rsi = F.col("close"), F.col("rsi_14")
    add = lambda yes, a, b: F.when(yes, a).when(~yes, b).otherwise(0)
    score = 50 + add(c > F.col("sma_50"), 10, -10) + add(c > F.col("sma_200"), 12, -12) + add(F.col("sma_50") > F.col("sma_200"), 8, -8)
    score = score + F.when(rsi.between(45, 65), 10).when(rsi.between(35, 72), 4).when(rsi > 78, -12).when(rsi < 30, -6).otherwise(0) + add(F.col("macd_line") > F.col("macd_signal"), 8, -8)
    score = score + F.when(F.col("volatility_30") < 0.18, 5).when(F.col("volatility_30") > 0.45, -10).otherwise(0) + F.when(F.col("max_drawdown") < -0.25, -8).otherwise(0)
    out = out.withColumn("score", F.round(clamp(score.cast("double")), 2))
    return out.withColumn("signal", signal_of(F.col("score")))


def targets(bars: DataFrame, horizon: int = 4, drop: float = -0.08) -> DataFrame:
    """What a model learns to foresee: return, its date, a drawdown on the way; NULL without a full horizon."""
    ahead, c = by().rowsBetween(1, horizon), F.col("close")
    worst = F.when(F.count("close").over(ahead) == horizon, divide(F.min("close").over(ahead), c) - 1)
    future = divide(F.lead("close", horizon).over(by()), c) - 1
    out = bars.withColumns({"future_return": future, "target_date": F.lead("date", horizon).over(by()), "worst": worst})
    return out.withColumns({"positive_return": (F.col("future_return") > 0).cast("int"), "drawdown_risk": (F.col("worst") <= drop).cast("int")})
