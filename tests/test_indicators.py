"""Frame preparation, crosses at ties, scores, overlay and models on small series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import indicators, learning, scoring


def bars_of(spark, **series):
    parts = [pd.DataFrame({"symbol": s, "date": pd.date_range("2024-01-01", periods=len(v)).date, "open": v, "high": np.array(v) * 1.01, "low": np.array(v) * 0.99, "close": v, "volume": 1e6 + 1000.0 * np.arange(len(v))}) for s, v in series.items()]
    return spark.createDataFrame(pd.concat(parts).astype({c: float for c in ("open", "high", "low", "close", "volume")}))


def test_prepare(spark):
    rows = [("A", "2026-01-01", None, None, None, "10", None, False, 1), ("A", "2026-01-02", "9", None, None, "11", "x", False, 2), ("A", "2026-01-02", "1", "2", "3", "4", "5", True, 1), ("A", "bad", "1", "1", "1", "1", "1", True, 1), ("A", "2026-01-03", "1", "1", "1", None, "1", True, 1), (None, "2026-01-04", "1", "1", "1", "1", "1", True, 1), ("A", "2026-01-05", "1", "1", "1", "NaN", "1", True, 1)]
    df = spark.createDataFrame(rows, "symbol string, date string, open string, high string, low string, close string, volume string, is_real boolean, id int")
    got = sorted((str(r.date), r.open, r.high, r.low, r.close, r.volume) for r in indicators.prepare(df).collect())
    assert got == [("2026-01-01", 10, 10, 10, 10, 0), ("2026-01-02", 1, 2, 3, 4, 5)]
    bare = indicators.prepare(df.select("symbol", "date", "close")).where("date = '2026-01-01'").first()
    assert (bare.open, bare.high, bare.low, bare.volume) == (10, 10, 10, 0)


def test_crosses_at_ties(spark):
    """The averages meet before they part: the cross is where they part, not where they meet."""
    close = [100.0] * 200 + [100.0] * 5 + [130.0] * 3 + [70.0] * 120
    rows = indicators.trend(bars_of(spark, A=close)).orderBy("date").toPandas()
    for k in range(1, len(rows)):
        a, b, x, y = rows["sma_50"][k - 1], rows["sma_200"][k - 1], rows["sma_50"][k], rows["sma_200"][k]
        known = not any(map(pd.isna, (a, b, x, y)))
        assert rows["golden_cross"][k] == (known and a <= b and x > y) and rows["death_cross"][k] == (known and a >= b and x < y)
    assert rows["golden_cross"].sum() == 1 and rows["golden_cross"][205] and rows["death_cross"].sum() == 1


ASSETS = [("up", "low"), ("down", "very_high"), ("short", "medium")]


@pytest.fixture(scope="module")
def scored(spark):
    bars = bars_of(spark, up=[100.0 + k for k in range(260)], down=[360.0 - k for k in range(260)], short=[10.0, 11.0, 12.0])
    return {r.symbol: r for r in scoring.technical(indicators.snapshot(bars), spark.createDataFrame(ASSETS, "symbol string, risk_level string")).collect()}


def test_scores_of_plain_trends(scored):
    up, down, short = scored["up"], scored["down"], scored["short"]
    assert up.close == 359 and up.trend_score == 100 and up.bias == "BULLISH" and up.score > down.score and up.computed_risk == "LOW"
    assert down.trend_score == 0 and down.bias != "BULLISH" and down.computed_risk == "HIGH" and down.risk_penalty == 70
    assert short.close == 12 and short.sma_50 is None and short.confidence == "LOW" and 0 <= short.score <= 100
    assert {"positive:ABOVE_SMA50", "positive:SMA50_ABOVE_SMA200", "positive:ADX_RISING"} <= {f"{x.kind}:{x.code}" for x in up.reasons}
    assert {x.code for x in short.reasons} >= {"NO_SMA50", "NO_SMA200"}
    assert up.trend_summary.startswith("Rising") and short.volatility_summary == "Unknown."
    for r in scored.values():
        want = 0.3 * r.trend_score + 0.25 * r.momentum_score + 0.15 * r.volatility_score + 0.1 * r.volume_score + 0.1 * r.support_resistance_score - 0.1 * r.risk_penalty
        assert r.score == pytest.approx(min(100, max(0, want)), abs=0.006)


def test_scores_dont_look_ahead(spark):
    flat = [100.0] * 90
    early = indicators.rolling_score(bars_of(spark, A=flat)).orderBy("date").collect()[89].score
    late = indicators.rolling_score(bars_of(spark, A=flat + [20.0] * 250)).orderBy("date").collect()[89].score
    assert early == late


def test_overlay(spark):
    base = spark.createDataFrame([("A", 68.0), ("B", 68.0), ("C", 99.0), ("D", 50.0)], "symbol string, score double")
    news = spark.createDataFrame([("A", "2026-01-05", 0.8, "HIGH"), ("A", "2026-01-20", 0.4, "LOW"), ("A", "2025-12-01", -1.0, "HIGH"), ("B", None, -0.5, "MEDIUM"), ("C", "2026-01-10", 1.0, "LOW")], "symbol string, published_at string, score double, impact string").withColumn("published_at", F.to_date("published_at"))
    got = {r.symbol: (r.news_count, r.news_score, r.final_score, r.final_signal, r.news_label, r.news_impact) for r in scoring.overlay(base, news, "2026-01-10").collect()}
    assert got == {"A": (2, 3.0, 71.0, "BUY", "POSITIVE", "HIGH"), "B": (1, -2.5, 65.5, "HOLD", "NEGATIVE", "MEDIUM"), "C": (1, 5.0, 100.0, "STRONG_BUY", "POSITIVE", "LOW"), "D": (0, 0.0, 50.0, "REDUCE", "NEUTRAL", "LOW")}


@pytest.fixture(scope="module")
def learned(spark):
    """Bars whose returns follow from the ones before, so that there is something to learn."""
    rng = np.random.default_rng(3)
    series = {}
    for s in ("a", "b", "c"):
        move, x = 0.0, [100.0]
        for _ in range(420):
            move = 0.85 * move + rng.normal(0, 0.004)
            x.append(x[-1] * (1 + move))
        series[s] = x
    bars = bars_of(spark, **series)
    news = spark.createDataFrame([("a", "2024-08-01", 0.5, "POSITIVE", "HIGH")], "symbol string, published_at string, score double, label string, impact string").withColumn("published_at", F.to_date("published_at"))
    return bars, news, learning.split_by_time(learning.dataset(bars, news, horizon=3)).cache()


def test_data_set(spark, learned):
    bars, news, parts = learned
    assert learning.looks_ahead(parts).isEmpty() and set(learning.FEATURES) <= set(parts.columns) and len(learning.FEATURES) == 28
    edge = parts.groupBy("part").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()
    by = {r.part: r for r in edge}
    assert by["train"].b < by["test"].a
    with_news = parts.where("news_positive > 0").select("symbol", "date").collect()
    assert {r.symbol for r in with_news} <= {"a"} and len(with_news) <= 7
    out = learning.dataset(bars, news, "OUTPERFORM_BENCHMARK", 3, "a")
    assert out.where("symbol = 'a' AND target = 1").isEmpty() and not out.where("target = 1").isEmpty()
    risk = learning.dataset(bars, news, "DRAWDOWN_RISK", 3)
    assert {r.target for r in risk.select("target").distinct().collect()} <= {0, 1}
    with pytest.raises(ValueError, match="unknown target"):
        learning.dataset(bars, news, "X")
    folds = learning.expanding_folds(parts.drop("part"), 3).groupBy("fold", "part").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()
    f = {(r.fold, r.part): r for r in folds}
    assert len(f) == 6 and all(f[k, "train"].b < f[k, "test"].a for k in (1, 2, 3)) and f[1, "train"].a == f[3, "train"].a
    few = parts.drop("part").where(F.col("date") < F.date_add(F.lit(by["train"].a), 5))
    assert learning.expanding_folds(few, 4).isEmpty()


def test_models_learn_and_repeat(spark, learned):
    _, _, parts = learned
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    for kind, options in (("LOGISTIC_REGRESSION", {}), ("RANDOM_FOREST", {"trees": 15}), ("GRADIENT_BOOSTING", {"rounds": 6})):
        model = learning.train(train, kind, **options)
        told = learning.predict(model, test).cache()
        m, area = learning.measures(told).first(), learning.auc(told)
        rows = [(r.target, r.probability) for r in told.collect()]
        pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert area == pytest.approx(want, abs=1e-6) and area > 0.6, kind
        assert m.accuracy == pytest.approx(sum((p >= 0.5) == (y == 1) for y, p in rows) / len(rows))
        again = learning.predict(learning.train(train, kind, **options), test).select("symbol", "date", "probability").collect()
        assert sorted(again) == sorted(told.select("symbol", "date", "probability").collect())
        names = [n for n, _ in learning.importances(model)]
        assert sorted(names) == sorted(learning.FEATURES)
        told.unpersist()
    judged = learning.judge(learning.predict(model, test), "POSITIVE_RETURN", m.f1, area).collect()
    assert all((r.label == "POSITIVE_RETURN") == (r.probability >= 0.5) for r in judged) and {r.confidence for r in judged} <= {"HIGH", "MEDIUM", "LOW"}
    with pytest.raises(ValueError, match="one kind"):
        learning.train(train.where("target = 1"))
    with pytest.raises(ValueError, match="unknown model"):
        learning.train(train, "X")


def test_walk_forward_and_shuffled_features(spark, learned):
    _, _, parts = learned
    got = learning.cross_validate(parts.drop("part"), "LOGISTIC_REGRESSION", 2)
    assert got["folds"] == 2 and 0 <= got["accuracy_std"] <= 0.5 and got["auc_mean"] > 0.55
    model = learning.train(parts.where("part = 'train'"))
    ranked = learning.permutation_importances(model, parts.where("part = 'test'"), ["return_1", "portfolio_weight"], repeats=2)
    assert dict(ranked)["portfolio_weight"] == 0


def test_models_are_saved(spark, learned, tmp_path):
    from pyspark.ml import PipelineModel

    _, _, parts = learned
    model = learning.train(parts.where("part = 'train'"))
    model.write().overwrite().save(str(tmp_path / "m"))
    a, b = (learning.predict(m, parts.where("part = 'test'")).select("symbol", "date", "probability").collect() for m in (model, PipelineModel.load(str(tmp_path / "m"))))
    assert sorted(a) == sorted(b)
