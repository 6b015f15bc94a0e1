"""Queries of backtests, benchmarks and their measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import backtest

from . import views
from .catalog import query
from .technical import scores


def market(spark, sf):
    grid = backtest.asof_grid(scores(spark, sf), "close", "score")
    return grid.join(backtest.folds(grid.select("date").distinct(), 4), "date")


def runs_of(spark, *rows):
    schema = "run_id string, strategy string, run_fold int, buy double, sell double, top int, most double, fee double, stop double, `take` double"
    return spark.createDataFrame([(i, s, f, 55.0, 40.0, 3, 0.2, 0.1, 8.0, 25.0) for i, s, f in rows], schema)


FOLDS = [(f"fold {k}", "SCORE_THRESHOLD", k) for k in range(4)]


@query("backtest_compare")
def backtest_compare(spark, sf):
    equity = backtest.simulate(market(spark, sf), runs_of(spark, *[(s, s, None) for s in backtest.STRATEGIES]))
    return backtest.metrics(equity)


@query("backtest_equity")
def backtest_equity(spark, sf):
    return backtest.simulate(market(spark, sf), runs_of(spark, ("top", "TOP_N_SCORE", None)))


@query("backtest_walk_forward")
def backtest_walk_forward(spark, sf):
    return backtest.metrics(backtest.simulate(market(spark, sf), runs_of(spark, *FOLDS)))


@query("backtest_verdict")
def backtest_verdict(spark, sf):
    """Spread and verdict of the walk-forward's folds against the benchmark."""
    rows = market(spark, sf)
    equity = backtest.simulate(rows, runs_of(spark, *FOLDS))
    return backtest.verdict(backtest.with_alpha(backtest.metrics(equity), equity, backtest.benchmark(rows, "Brand#11")))


GRID = """d AS (SELECT DISTINCT date FROM prices), s AS (SELECT DISTINCT symbol FROM prices), grid AS (SELECT s.symbol, d.date, p.close FROM d CROSS JOIN s ASOF JOIN prices p ON s.symbol = p.symbol AND d.date >= p.date)"""


@query("benchmark_curve", f"WITH {GRID}, b AS (SELECT date, close, first(close) OVER (ORDER BY date) AS f FROM grid WHERE symbol = 'Brand#11') SELECT date, round((close / f - 1) * 100, 4) AS benchmark_return, round(100000 * close / f, 3) AS benchmark_value FROM b", "prices")
def benchmark_curve(spark, sf):
    out = backtest.benchmark(backtest.asof_grid(views.prices(spark, sf), "close"), "Brand#11")
    return out.select("date", F.round("benchmark_return", 4).alias("benchmark_return"), F.round("benchmark_value", 3).alias("benchmark_value"))


HELD = f"""{GRID}, start AS (SELECT symbol, close AS paid, count(*) OVER () AS n FROM grid WHERE date = (SELECT min(date) FROM grid) AND close > 0), bought AS (SELECT symbol, n, 100000 / n::DOUBLE / 1.001::DOUBLE / paid AS quantity, paid FROM start),
    equity AS (SELECT date, sum(quantity * close) AS equity FROM grid JOIN bought USING (symbol) GROUP BY date)"""


def _held(spark, sf):
    return backtest.hold(backtest.asof_grid(views.prices(spark, sf), "close"), "hold", fee=0.1)


@query("hold_equity", f"WITH {HELD} SELECT 'hold' AS run_id, date, round(equity, 3) AS equity, 0.0::DOUBLE AS cash FROM equity", "prices")
def hold_equity(spark, sf):
    equity, _ = _held(spark, sf)
    return equity.select("run_id", "date", F.round("equity", 3).alias("equity"), (F.round("cash", 3) + 0.0).alias("cash"))


@query("hold_net", f"""WITH {HELD}, m AS (SELECT arg_max(equity, date) AS final, avg(equity) AS mean, greatest(max(date) - min(date), 1) / 365.25::DOUBLE AS years FROM equity), t AS (SELECT sum(100000 / n::DOUBLE - quantity * paid) AS commission, sum(100000 / n::DOUBLE) * .05::DOUBLE / 100 AS slippage FROM bought)
    SELECT 'hold' AS run_id, round(final, 2) AS final, round(commission, 3) AS commission, round(slippage, 3) AS slippage, round(mean * .2::DOUBLE / 100 * years, 3) AS stamp_duty, round(final - slippage - mean * .2::DOUBLE / 100 * years, 2) AS net_final FROM m, t""", "prices")
def hold_net(spark, sf):
    """What is left of buying and keeping: no gain is realised, so no tax, but slippage and stamp duty."""
    equity, trades = _held(spark, sf)
    out = backtest.net_analysis(trades, equity, views.assets(spark, sf))
    return out.select("run_id", F.round("final", 2).alias("final"), *[F.round(c, 3).alias(c) for c in ("commission", "slippage", "stamp_duty")], F.round("net_final", 2).alias("net_final"))


@query("curves_by_date", f"WITH {HELD}, b AS (SELECT date, 100000 * close / first(close) OVER (ORDER BY date) AS benchmark FROM grid WHERE symbol = 'Brand#11') SELECT date, round(equity, 3) AS hold, round(benchmark, 3) AS benchmark FROM equity FULL JOIN b USING (date)", "prices")
def curves_by_date(spark, sf):
    """Buy-and-hold and its benchmark, a column each."""
    equity, _ = _held(spark, sf)
    bench = backtest.benchmark(backtest.asof_grid(views.prices(spark, sf), "close"), "Brand#11").select(F.lit("benchmark").alias("run_id"), "date", F.col("benchmark_value").alias("equity"))
    out = backtest.side_by_side(equity.select("run_id", "date", "equity").unionByName(bench), "hold", "benchmark")
    return out.select("date", F.round("hold", 3).alias("hold"), F.round("benchmark", 3).alias("benchmark"))
