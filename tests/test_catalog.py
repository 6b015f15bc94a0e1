"""Every analytics query against its SQL; those without are held to what must be true of their rows."""

import pytest

import sqlcheck
from quantloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    sqlcheck.check(catalog.QUERIES[name](spark, sf), catalog.SQL[name], sf)


def rows_of(spark, sf, name):
    return catalog.QUERIES[name](spark, sf).collect()


def true_of_compare(rows):
    assert sorted(r.run_id for r in rows) == ["BUY_AND_HOLD", "SCORE_THRESHOLD", "TOP_N_SCORE"] and sorted(r.place for r in rows) == [1, 2, 3]
    assert [r.run_id for r in sorted(rows, key=lambda r: r.place)] == [r.run_id for r in sorted(rows, key=lambda r: -r.total_return)]
    for r in rows:
        assert r.total_return == pytest.approx((r.final / 100_000 - 1) * 100) and r.max_drawdown <= 0 and 0 <= r.wins <= r.trades


def true_of_equity(rows):
    peak = 100_000.0
    for r in sorted(rows, key=lambda r: r.date):
        peak = max(peak, r.equity)
        assert -1e-6 <= r.cash <= r.equity + 1e-6 and r.drawdown == pytest.approx((r.equity / peak - 1) * 100)
    assert len({r.date for r in rows}) == len(rows) == 357


def true_of_walk_forward(rows):
    assert sorted(r.run_id for r in rows) == [f"fold {k}" for k in range(4)] and all(r.final > 0 for r in rows)


def true_of_verdict(rows):
    (r,) = rows
    assert r.folds == 4 and r.worst <= r.median_return <= r.best and 0 <= r.positive <= 4 and 0 <= r.beating <= 4
    share = r.positive / 4
    want = "ROBUST" if share >= 0.7 and r.mean_alpha > 0 else "FRAGILE" if share <= 0.4 or r.mean_return <= 0 else "UNCERTAIN"
    assert r.verdict == want


def true_of_logistic(rows):
    (r,) = rows
    n = r.tp + r.fp + r.fn + r.tn
    assert n > 0 and r.accuracy == pytest.approx((r.tp + r.tn) / n) and (r.auc is None or 0 <= r.auc <= 1)


def true_of_predictions(rows):
    assert len(rows) == 25
    for r in rows:
        assert 0 <= r.probability <= 1 and r.label == ("POSITIVE_RETURN" if r.probability >= 0.5 else "NON_POSITIVE_RETURN") and r.confidence in ("HIGH", "MEDIUM", "LOW")


def true_of_permuted(rows):
    from quantloom.operators.learning import FEATURES

    assert sorted(r.feature for r in rows) == sorted(FEATURES) and all(-1 <= r.importance <= 1 for r in rows)
    assert {r.feature: r.importance for r in rows}["portfolio_weight"] == 0  # 0 in every training row


TRUE_OF = {
    "backtest_compare": true_of_compare, "backtest_equity": true_of_equity, "backtest_walk_forward": true_of_walk_forward, "backtest_verdict": true_of_verdict,
    "ml_logistic": true_of_logistic, "ml_forest": true_of_logistic, "ml_boosted": true_of_logistic, "ml_permuted": true_of_permuted, "ml_predictions": true_of_predictions,
}


def test_all_queries_are_held_to_something():
    assert set(catalog.QUERIES) == set(catalog.SQL) | set(TRUE_OF)


@pytest.mark.parametrize("name", sorted(TRUE_OF))
def test_query_without_sql(spark, sf, name):
    TRUE_OF[name](rows_of(spark, sf, name))
