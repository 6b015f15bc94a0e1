"""Stress scenarios on a worked example and on the small table."""

import pytest

from quantloom.operators import portfolio
from quantloom.plans import books, catalog, views


def test_six_scenarios(spark):
    rows = [("stock", 1000.0), (None, 500.0), ("crypto", 300.0), ("bond", 200.0), ("gold", 100.0), ("etf", None)]
    valued = spark.createDataFrame(rows, "asset_type string, value double")
    got = {r.scenario: (r.loss, r.loss_percent, r.risk_level) for r in portfolio.scenarios(valued).collect()}
    assert got == {
        "MARKET_CRASH": (-516.0, -24.57, "HIGH"), "TECH_SELLOFF": (-343.0, -16.33, "HIGH"), "CRYPTO_WINTER": (-210.0, -10.0, "MEDIUM"),
        "RATE_HIKE": (-189.0, -9.0, "MEDIUM"), "INFLATION_SHOCK": (-226.0, -10.76, "MEDIUM"), "MILD_CORRECTION": (-143.0, -6.81, "MEDIUM"),
    }
    assert {r.risk_level for r in portfolio.scenarios(valued, 1e6).collect()} == {"LOW"}


def test_presets_over_the_small_table(spark, sf):
    total = books.valued(spark, sf).agg({"value": "sum"}).first()[0]
    (cash,) = spark.range(1).select(views.cash(spark, sf)).first()
    rows = catalog.QUERIES["scenario_presets"](spark, sf).collect()
    assert {r.scenario for r in rows} == set(portfolio.SCENARIOS) and all(r.value == pytest.approx(total + cash, abs=0.01) for r in rows)
