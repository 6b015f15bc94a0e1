"""Grid and simulator on small worked examples."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest


def test_grid_has_every_symbol(spark):
    n = 10_050
    rows = spark.range(n).select(F.concat(F.lit("s"), "id").alias("symbol"), F.when(F.col("id") % 2 == 0, F.lit("2026-01-01")).otherwise(F.lit("2026-01-02")).cast("date").alias("date"), F.col("id").cast("double").alias("close"))
    grid = backtest.asof_grid(rows, "close")
    assert grid.columns == ["symbol", "date", "close"]
    got = grid.agg(F.count(F.lit(1)).alias("k"), F.count_distinct("symbol").alias("symbols"), F.sum((F.concat(F.lit("s"), F.col("close").cast("long")) == F.col("symbol")).cast("int")).alias("own")).first()
    assert (got.symbols, got.k, got.own) == (n, n // 2 * 2 + n // 2, n // 2 * 3)


def test_grid_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", "2026-01-01", 1.0), ("a", "2026-01-03", 3.0), ("b", "2026-01-02", None), ("c", None, 5.0), (None, "2026-01-04", 6.0)], "symbol string, date string, close double").withColumn("date", F.to_date("date"))
    got = sorted((r.symbol, r.date.day, r.close) for r in backtest.asof_grid(rows, "close").collect())
    assert got == [("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 3.0), ("a", 4, 3.0), ("b", 2, None), ("b", 3, None), ("b", 4, None)]
    assert backtest.asof_grid(rows.limit(0), "close").count() == 0


RUN = "run_id string, strategy string, run_fold int, buy double, sell double, top int, most double, fee double, stop double, `take` double"
MARKET = "symbol string, date string, close double, score double, fold int"


def market_of(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], MARKET).withColumn("date", F.to_date("date"))


def test_top_n_targets_and_trim(spark):
    """Two of weight 1/2 each (most is 0.8); A doubles, so 25,000 over target is sold a week on and buys B."""
    rows = [("A", "2026-01-05", 100.0, 80.0), ("B", "2026-01-05", 100.0, 70.0), ("C", "2026-01-05", 100.0, 10.0), ("A", "2026-01-12", 200.0, 80.0), ("B", "2026-01-12", 100.0, 70.0), ("C", "2026-01-12", 100.0, 10.0)]
    rows += [(s, "2026-01-13", p, 50.0) for s, p in (("A", 200.0), ("B", 200.0), ("C", 100.0))]
    runs = spark.createDataFrame([("r", "TOP_N_SCORE", None, 55.0, 40.0, 2, 0.8, 0.0, 90.0, 900.0)], RUN)
    got = backtest.simulate(market_of(spark, rows), runs).orderBy("date").collect()
    assert [r.equity for r in got] == pytest.approx([100_000, 150_000, 225_000])
    assert [r.cash for r in got] == pytest.approx([0, 0, 0], abs=1e-6)
    assert [r.trades for r in got] == [2, 4, 4] and got[-1].wins == 1


def test_top_n_trims_beyond_five_percent_only(spark):
    runs = spark.createDataFrame([("r", "TOP_N_SCORE", None, 55.0, 40.0, 1, 0.5, 0.0, 90.0, 900.0)], RUN)
    for price, cash in ((110.0, 50_000), (150.0, 62_500)):
        got = backtest.simulate(market_of(spark, [("A", "2026-01-05", 100.0, 80.0), ("A", "2026-01-12", price, 80.0)]), runs).orderBy("date").collect()
        assert got[-1].cash == pytest.approx(cash)


def test_group_has_candidates_only_and_every_day(spark):
    days = ["2026-01-05", "2026-01-06", "2026-01-12"]
    market = market_of(spark, [(f"s{k:02d}", d, 10.0, 40.0 + k) for k in range(30) for d in days] + [("t", days[1], 5.0, 99.0)])
    runs = spark.createDataFrame([("top", "TOP_N_SCORE", None, 55.0, 40.0, 3, 0.2, 0.1, 8.0, 25.0), ("all", "SCORE_THRESHOLD", None, 68.0, 40.0, 3, 0.2, 0.1, 8.0, 25.0), ("none", "SCORE_THRESHOLD", None, 999.0, 40.0, 3, 0.2, 0.1, 8.0, 25.0)], RUN)
    ranked = market.withColumn("place", F.row_number().over(backtest.W.partitionBy("date").orderBy(F.desc("score"), "symbol")))
    got = backtest.candidates(ranked.crossJoin(runs)).groupBy("run_id").agg(F.count_distinct("symbol").alias("k"), F.count_distinct("date").alias("days")).collect()
    assert {r.run_id: (r.k, r.days) for r in got} == {"top": (4, 3), "all": (3, 3), "none": (2, 3)}
    assert backtest.simulate(market, runs).groupBy("run_id").count().where("count = 3").count() == 3
