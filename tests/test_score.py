"""The rolling score against a bar-by-bar one in plain pandas."""

import numpy as np
import pandas as pd

from quantloom.operators import indicators
from quantloom.plans import catalog, views


def score_row(x):
    score, have = 50.0, pd.notna
    if have(x.sma_50):
        score += 10 if x.close > x.sma_50 else -10
    if have(x.sma_200):
        score += 12 if x.close > x.sma_200 else -12
    if have(x.sma_50) and have(x.sma_200):
        score += 8 if x.sma_50 > x.sma_200 else -8
    if have(x.rsi):
        if 45 <= x.rsi <= 65:
            score += 10
        elif 35 <= x.rsi < 45 or 65 < x.rsi <= 72:
            score += 4
        elif x.rsi > 78:
            score -= 12
        elif x.rsi < 30:
            score -= 6
    if have(x.macd) and have(x.macd_signal):
        score += 8 if x.macd > x.macd_signal else -8
    if have(x.volatility):
        if x.volatility < 0.18:
            score += 5
        elif x.volatility > 0.45:
            score -= 10
    if have(x.drawdown) and x.drawdown < -0.25:
        score -= 8
    return round(min(100, max(0, score)), 2)


def brute(bars):
    out = {}
    for symbol, x in bars.groupby("symbol"):
        x = x.sort_values("date", ignore_index=True)
        c = x["close"].astype(float)
        move = c.diff()
        gain, loss = move.clip(lower=0).rolling(14).mean(), (-move).clip(lower=0).rolling(14).mean()
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        rsi = (100 - 100 / (1 + gain / loss.replace(0, np.nan))).mask((loss == 0) & (gain > 0), 100.0)
        rows = pd.DataFrame({
            "date": x["date"], "close": c, "sma_50": c.rolling(50).mean(), "sma_200": c.rolling(200).mean(), "rsi": rsi, "macd": macd, "macd_signal": macd.ewm(span=9, adjust=False).mean(),
            "volatility": c.pct_change().rolling(30).std() * np.sqrt(252), "drawdown": (c / c.cummax() - 1).cummin(),
        })
        out |= {(symbol, r.date): score_row(r) for r in rows.itertuples()}
    return out


def test_score_of_every_bar(spark, sf):
    want = brute(views.prices(spark, sf).toPandas())
    rows = catalog.QUERIES["rolling_score_signal"](spark, sf).collect()
    assert {(r.symbol, r.date): r.score for r in rows} == want
    for r in rows:
        assert r.signal == next((n for least, n in ((80, "STRONG_BUY"), (70, "BUY"), (55, "HOLD"), (40, "REDUCE")) if r.score >= least), "SELL")


def test_score_of_calm_and_wild_walks(spark):
    rng, parts = np.random.default_rng(5), []
    for symbol, spread in (("calm", 0.006), ("mild", 0.02), ("wild", 0.05)):
        close = 100 * np.exp(np.cumsum(rng.normal(0.0005, spread, 320)))
        parts.append(pd.DataFrame({"symbol": symbol, "date": pd.date_range("2024-01-01", periods=320).date, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": 1.0}))
    bars = pd.concat(parts)
    rows = indicators.rolling_score(spark.createDataFrame(bars)).collect()
    assert {(r.symbol, r.date): r.score for r in rows} == brute(bars)
