"""Lots, taxes, risk rules, allocation and scenarios on worked examples."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quantloom.functions.numeric import signal_of
from quantloom.operators import backtest, portfolio, scan

ORDERS = "symbol string, side string, quantity double, price double, fees double, order_date string, seq int"


def orders_of(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], ORDERS).withColumn("order_date", F.to_date("order_date"))


def assets_of(spark, *rows):
    return spark.createDataFrame(rows, "symbol string, asset_type string")


def test_fifo_of_known_orders(spark):
    """10 at 100 and 10 at 120 bought, 15 at 180 sold: cost 1600, proceeds 2700, gain 1100, tax 286, 5 left."""
    orders = orders_of(spark, [("A", "BUY", 10.0, 100.0, 0.0, "2026-01-01"), ("A", "BUY", 10.0, 120.0, 0.0, "2026-01-02"), ("A", "SELL", 15.0, 180.0, 0.0, "2026-01-13")])
    assets = assets_of(spark, ("A", "stock"))
    (e,) = portfolio.tax_events(portfolio.fifo(orders), assets).collect()
    assert (e.quantity, e.cost, e.proceeds, e.gain, e.rate, e.holding_days) == (15, 1600, 2700, 1100, 26, 11)
    taxed = {r.category: r for r in portfolio.tax(portfolio.tax_events(portfolio.fifo(orders), assets)).collect()}
    assert taxed["standard"].tax == pytest.approx(286) and taxed["bond"].tax == 0
    prices = spark.createDataFrame([("A", 200.0)], "symbol string, close double")
    (lot,) = portfolio.open_lots(orders, prices, assets).collect()
    assert (lot.quantity, lot.cost, lot.value, lot.unrealized) == (5, 600, 1000, 400)


def test_losses_are_carried_on(spark):
    """2025: 10 bought at 200, sold at 150; 2026: bought at 100, sold at 160; carry 500, then tax 26."""
    orders = orders_of(spark, [("A", "BUY", 10.0, 200.0, 0.0, "2025-01-01"), ("A", "SELL", 10.0, 150.0, 0.0, "2025-02-01"), ("A", "BUY", 10.0, 100.0, 0.0, "2026-01-01"), ("A", "SELL", 10.0, 160.0, 0.0, "2026-02-01")])
    taxed = portfolio.tax(portfolio.tax_events(portfolio.fifo(orders), assets_of(spark, ("A", "stock"))))
    got = {r.year: (r.tax, r.carry, r.used) for r in taxed.where("category = 'standard'").collect()}
    assert got == {2025: (0, 500, 0), 2026: (pytest.approx(26), 0, 500)}
    years = {r.year: (r.gains, r.losses, r.net, r.carry) for r in portfolio.tax_years(taxed).collect()}
    assert years == {2025: (0, 500, -500, 500), 2026: (600, 0, 600, 0)}


def queued(rows):
    """Whole billionths through queues: of every sell parts, cost, proceeds and the day of its last lot, and what is left of each symbol."""
    want, queues = {}, {}
    for k, (s, side, q, price, fees, day) in enumerate(rows):
        parts, lots = round(q * 1e9), queues.setdefault(s, deque())
        if side == "BUY":
            lots.append([parts, price + fees / q, day])
            continue
        left, cost, bought = parts, 0.0, None
        while left and lots:
            take = min(left, lots[0][0])
            cost, left, lots[0][0], bought = cost + take / 1e9 * lots[0][1], left - take, lots[0][0] - take, lots[0][2]
            if not lots[0][0]:
                lots.popleft()
        if left < parts:
            want[k] = ((parts - left), cost, (price - fees / q) * (parts - left) / 1e9, bought)
    return want, {s: (sum(x[0] for x in q), sum(x[0] / 1e9 * x[1] for x in q)) for s, q in queues.items() if q}


def same_as_queues(spark, rows):
    want, left = queued(rows)
    orders = orders_of(spark, rows)
    got = portfolio.fifo(orders).groupBy("sell").agg(F.sum("parts").alias("q"), F.sum("cost").alias("c"), F.sum("proceeds").alias("p"), F.max_by("buy_date", "buy").alias("d")).collect()
    assert {r.sell: (r.q, pytest.approx(r.c / 1e6, abs=1e-3), pytest.approx(r.p / 1e6, abs=1e-3), str(r.d)) for r in got} == want
    prices, assets = spark.createDataFrame([("A", 1.0)], "symbol string, close double"), assets_of(spark, ("A", "stock"))
    lots = {r.symbol: (r.quantity, r.cost) for r in portfolio.open_lots(orders, prices, assets).collect()}
    assert lots == {s: (n / 1e9, pytest.approx(c, abs=0.02)) for s, (n, c) in left.items()}


@pytest.mark.parametrize("seed", range(3))
def test_fifo_against_queues(spark, seed):
    rng, rows = random.Random(seed), []
    amount = [lambda: float(rng.randint(1, 30)), lambda: rng.choice((0.1, 0.2, 0.3, 0.18, 2.5, 1.0, 1e-9, 0.7)), lambda: round(rng.random() * 3, rng.randint(1, 8)) + 1e-8][seed]
    for k in range(500):
        rows.append((rng.choice("AAB"), rng.choice(["BUY", "BUY", "SELL"]) if k % 100 < 60 else "SELL", amount(), rng.randint(100, 9999) / 100, rng.randint(0, 300) / 100, f"2025-{1 + k // 50:02d}-{1 + k % 28:02d}"))
    same_as_queues(spark, rows)


def test_fractions_meet_where_they_are_equal(spark):
    rows = [("A", "BUY", 0.3, 10.0, 0.0, "2024-01-01"), ("A", "BUY", 1.0, 10.0, 0.0, "2025-01-01"), ("A", "SELL", 0.1, 10.0, 0.0, "2025-06-02"), ("A", "SELL", 0.2, 10.0, 0.0, "2025-06-02")]
    events = portfolio.tax_events(portfolio.fifo(orders_of(spark, rows)), assets_of(spark, ("A", "stock"))).orderBy("sell").collect()
    assert [(e.quantity, e.holding_days) for e in events] == [(0.1, 518), (0.2, 518)]
    rows = [("A", "BUY", 0.1, 10.0, 0.0, "2024-01-01"), ("A", "BUY", 0.2, 10.0, 0.0, "2024-01-01"), ("A", "SELL", 0.3, 10.0, 0.0, "2024-02-01"), ("B", "BUY", 4e-10, 10.0, 0.0, "2024-01-01")]
    assert portfolio.open_lots(orders_of(spark, rows), spark.createDataFrame([("A", 1.0)], "symbol string, close double"), assets_of(spark, ("A", "stock"))).count() == 0
    assert portfolio.fifo(orders_of(spark, rows).limit(0)).count() == 0


def test_one_symbol_fills_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 10_000)
    rng, rows = random.Random(8), []
    for k in range(20_000):
        rows.append(("A", "BUY" if rng.random() < (0.7 if k % 4000 < 2000 else 0.3) else "SELL", rng.randint(1, 300) / 100, rng.randint(100, 9999) / 100, 0.0, f"2025-{1 + k // 2000:02d}-{1 + k % 28:02d}"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = scan.cut(orders_of(spark, rows), True, "symbol", "seq").groupBy("chunk").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).orderBy("chunk").collect()
        assert len(chunks) == 16 and max(c.n for c in chunks) < 4000 and all(a.hi < b.lo for a, b in zip(chunks, chunks[1:]))
        same_as_queues(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def moved(spark, since=-1):
    """The last stage, and bytes shuffled, spilled and written in those after ``since``."""
    array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, array, None)
    found = [x for x in map(stages.apply, range(stages.size())) if x.stageId() > since]
    return max((x.stageId() for x in found), default=since), sum(x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in found)


def test_a_long_symbol_is_shuffled_once_and_its_matched_part_again(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 10_000)
    rows = spark.range(60_000, numPartitions=2).select(
        F.lit("A").alias("symbol"), F.when(F.col("id") % 3 == 0, "SELL").otherwise("BUY").alias("side"), (F.col("id") % 49 + 1).cast("double").alias("quantity"), (F.xxhash64("id") % 1000 / 100 + 20).alias("price"),
        (F.col("id") % 7 / 10).alias("fees"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 100).cast("int")).alias("order_date"), F.struct(F.col("id"), (F.xxhash64("id") % 1_000_000).alias("k"), F.col("id").alias("l")).alias("seq"),
    )
    before, _ = moved(spark)
    assert portfolio.tax_events(portfolio.fifo(rows), assets_of(spark, ("A", "stock"))).agg(F.sum("gain")).first()[0] is not None
    assert 0 < moved(spark, before)[1] < 160 * 60_000  # 227 a row with ranges and chunks dealt again, 110 now


def test_intervals_that_reach_over_many_chunks(spark, monkeypatch):
    """A buy that many sells take from, then many buys for one sell, then more sold than held."""
    monkeypatch.setattr(scan, "CHUNK", 512)
    day = lambda k: f"2025-{1 + k % 12:02d}-{1 + k % 28:02d}"
    rows = [("A", "BUY", 1500.0, 10.0, 1.0, day(0))] + [("A", "SELL", 1.0, 11.0 + k % 5, 0.0, day(k)) for k in range(1400)]
    rows += [("A", "BUY", 2.0, 9.0 + k % 7, 0.5, day(k)) for k in range(1400)] + [("A", "SELL", 2800.0, 12.0, 0.0, day(1)), ("A", "SELL", 500.0, 12.0, 0.0, day(2)), ("A", "BUY", 3.0, 10.0, 0.0, day(3)), ("B", "BUY", 1.0, 5.0, 0.0, day(4)), ("B", "SELL", 0.5, 6.0, 0.0, day(5))]
    found = scan.bounds(orders_of(spark, rows), "symbol", "seq").collect()
    assert [r.symbol for r in found] == ["A"] and len(found[0].bounds) > 5
    same_as_queues(spark, rows)


LIMITS = portfolio.LIMITS


def warned(spark, rows, cash, **limits):
    valued = spark.createDataFrame(rows, "symbol string, asset_type string, value double, weight double, signal string")
    return {r.code: (r.level, r.subject) for r in portfolio.warnings(valued.drop("signal"), valued.select("symbol", "signal"), F.lit(cash), LIMITS | limits).collect()}


def test_each_warning(spark):
    assert warned(spark, [("A", "stock", 0.0, 99.0, None)], 0.0) == {"SINGLE_ASSET_CONCENTRATION": ("WARNING", "A"), "ASSET_CLASS_CONCENTRATION": ("WARNING", "stock"), "TOP_THREE_CONCENTRATION": ("WARNING", None)}
    assert warned(spark, [("A", "stock", 9e4, 30.0, "BUY")], 1e4) == {"SINGLE_ASSET_CONCENTRATION": ("WARNING", "A")}
    assert "ASSET_CLASS_CONCENTRATION" in warned(spark, [("A", "stock", 4e4, 20.0, "BUY"), ("B", "stock", 5e4, 40.0, "BUY")], 1e4)
    assert "CRYPTO_OVERWEIGHT" in warned(spark, [("BTC", "crypto", 9e4, 20.0, "BUY")], 1e4)
    assert warned(spark, [("A", "stock", 99_500.0, 10.0, "BUY")], 500.0) == {"LOW_CASH": ("WARNING", None)}
    assert warned(spark, [("A", "stock", 5e4, 10.0, "BUY")], 5e4) == {"HIGH_CASH": ("INFO", None)}
    three = [("A", "stock", 3e4, 24.0, "BUY"), ("B", "stock", 3e4, 24.0, "BUY"), ("C", "stock", 3e4, 24.0, "BUY"), ("D", "stock", 5e3, 5.0, "BUY")]
    assert warned(spark, three, 1e4, **{"asset": 30.0, "class": 90.0}) == {"TOP_THREE_CONCENTRATION": ("WARNING", None)}
    assert warned(spark, [("T", "stock", 9e4, 18.0, "SELL")], 1e4) == {"WEAK_SIGNAL_OVERWEIGHT": ("WARNING", "T")}


@pytest.mark.parametrize(
    ("signal", "weight", "kind", "risk", "class_weight", "want"),
    [
        ("BUY", 30.0, "stock", "medium", 30.0, "BLOCK_BUY_TOO_CONCENTRATED"), ("BUY", 25.0, "stock", "medium", 25.0, "BLOCK_BUY_TOO_CONCENTRATED"), ("BUY", 5.0, "stock", "low", 50.0, "BLOCK_BUY_TOO_CONCENTRATED"),
        ("BUY", 5.0, "crypto", "low", 15.0, "BLOCK_BUY_HIGH_RISK"), ("HOLD", 5.0, "crypto", "very_high", 5.0, "BLOCK_BUY_HIGH_RISK"), ("BUY", 5.0, "stock", "high", 10.0, "BUY_ALLOWED"), ("BUY", 5.0, "stock", "medium", 10.0, "BUY_ALLOWED"),
        ("SELL", 5.0, "stock", "low", 10.0, "SELL"), ("REDUCE", 5.0, "stock", "low", 10.0, "REDUCE"), ("STRONG_BUY", 20.0, "stock", "low", 30.0, "HOLD"), (None, 5.0, "stock", "low", 10.0, "HOLD"), (None, 0.0, "stock", "high", 0.0, "BLOCK_BUY_HIGH_RISK"),
    ],
)
def test_recommendation(spark, signal, weight, kind, risk, class_weight, want):
    held = [("A", kind, weight, weight)] + [("Z", kind, class_weight - weight, 0.0)] * (class_weight > weight)
    valued = spark.createDataFrame(held, "symbol string, asset_type string, weight double, value double")
    assets = spark.createDataFrame([("A", kind, risk)], "symbol string, asset_type string, risk_level string")
    signals = spark.createDataFrame([("A", signal, 60.0)], "symbol string, signal string, score double")
    assert [r.recommendation for r in portfolio.recommend(valued, signals, assets).collect()] == [want]


def test_board_orders_and_stays_short(spark):
    advice = [(f"b{k}", "BUY", 70.0 + k, 0.0, "BUY_ALLOWED") for k in range(8)] + [("s", "SELL", 30.0, 5.0, "BLOCK_BUY_HIGH_RISK"), ("r", "REDUCE", 45.0, 5.0, "REDUCE"), ("h", "HOLD", 60.0, 5.0, "HOLD"), ("n", "SELL", 20.0, 0.0, "SELL")]
    rows = spark.createDataFrame(advice, "symbol string, signal string, score double, weight double, recommendation string")
    warned_rows = spark.createDataFrame([("INFO", "HIGH_CASH", None, 40.0), ("WARNING", "LOW_CASH", None, 1.0)], "level string, code string, subject string, value double")
    got = portfolio.board(rows, warned_rows).orderBy("rank", F.desc_nulls_last("score"), "code").collect()
    assert [(r.kind, r.priority, r.symbol) for r in got] == [
        ("BUY", "HIGH", "b7"), ("BUY", "HIGH", "b6"), ("BUY", "HIGH", "b5"), ("SELL", "HIGH", "s"), ("RISK", "HIGH", None), ("BUY", "MEDIUM", "b4"), ("BUY", "MEDIUM", "b3"), ("BUY", "MEDIUM", "b2"), ("REDUCE", "MEDIUM", "r"), ("RISK", "LOW", None),
    ]
    quiet = portfolio.board(rows.where("symbol = 'h'"), warned_rows.limit(0)).collect()
    assert [(r.kind, r.code) for r in quiet] == [("OK", "NOTHING_URGENT")]


def test_caps_sum_to_one(spark):
    bars = spark.createDataFrame([(s, f"2026-01-{d:02d}", 100.0 + (d % 2) * k) for k, s in enumerate("abcde", 1) for d in range(1, 25)], "symbol string, date string, close double").withColumn("date", F.to_date("date"))
    signals = spark.createDataFrame([(s, 55.0 + 9 * k * k) for k, s in enumerate("abcde")], "symbol string, score double")
    free = {r.symbol: r for r in portfolio.allocate(bars, signals).collect()}
    capped = {r.symbol: r for r in portfolio.allocate(bars, signals, most=0.3).collect()}
    for m in ("equal", "risk_parity", "score_weighted"):
        assert sum(r[m] for r in free.values()) == pytest.approx(1) and sum(r[m] for r in capped.values()) == pytest.approx(1) and max(r[m] for r in capped.values()) <= 0.3 + 1e-9
    assert max(r.risk_parity for r in free.values()) > 0.3
    assert {s: r.risk_parity for s, r in portfolio_rows(portfolio.allocate(bars, signals, most=0.15))} == {s: pytest.approx(r.risk_parity) for s, r in free.items()}


def portfolio_rows(df):
    return [(r.symbol, r) for r in df.collect()]


def test_score_edges(spark):
    edges = [95.0, 80.0, 79.99, 70.0, 69.99, 55.0, 54.99, 40.0, 39.99, 0.0, None]
    got = [r.s for r in spark.createDataFrame(list(enumerate(edges)), "i int, x double").select("i", signal_of(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == ["STRONG_BUY", "STRONG_BUY", "BUY", "BUY", "HOLD", "HOLD", "REDUCE", "REDUCE", "SELL", "SELL", None]


def test_symbol_shocks_go_first(spark):
    valued = spark.createDataFrame([("A", "stock", 1000.0), ("B", "stock", 500.0), ("C", "etf", 100.0)], "symbol string, asset_type string, value double")
    got = {r.symbol: (r.shock, r.impact, r.contribution) for r in portfolio.impacts(valued, {"CUSTOM": {"stock": -10}}, {"a": -50}).collect()}
    assert got == {"A": (-50, -500, pytest.approx(500 / 5.5)), "B": (-10, -50, pytest.approx(50 / 5.5)), "C": (0, 0, 0)}
    (r,) = portfolio.scenarios(valued, 16.0, {"CUSTOM": {"stock": -10}}, {"A": -50}).collect()
    assert (r.loss, r.risk_level, r.tips) == (-550, "EXTREME", "REDUCE_RISK,RAISE_CASH,DIVERSIFY:stock")


def test_paper_account(spark):
    orders = orders_of(spark, [("A", "BUY", 10.0, 100.0, 1.0, "2026-01-01"), ("A", "SELL", 4.0, 120.0, 1.0, "2026-01-02"), ("B", "BUY", 100.0, 100.0, 0.0, "2026-01-03")]).withColumn("account", F.lit(1))
    rows = portfolio.paper_account(orders, 2000.0).orderBy("seq").collect()
    assert [(r.net, r.cash, r.short) for r in rows] == [(1001, 999, False), (479, 1478, False), (10_000, -8522, True)]


def test_folds_need_dates(spark):
    days = spark.range(7).select(F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    assert sorted(r.fold for r in backtest.folds(days, 3).collect()) == [0, 0, 1, 1, 2, 2, 2]
    with pytest.raises(Exception, match="4 folds need 8 dates"):
        backtest.folds(days, 4).collect()


def test_equity_of_holding_one_asset(spark):
    market = spark.createDataFrame([("A", f"2026-01-{d:02d}", 100.0 + d, 50.0, 0) for d in range(1, 20)], "symbol string, date string, close double, score double, fold int").withColumn("date", F.to_date("date"))
    runs = spark.createDataFrame([("r", "BUY_AND_HOLD", None, 55.0, 40.0, 1, 1.0, 0.0, 90.0, 900.0)], "run_id string, strategy string, run_fold int, buy double, sell double, top int, most double, fee double, stop double, `take` double")
    rows = backtest.simulate(market, runs).orderBy("date").collect()
    assert rows[-1].equity == pytest.approx(100_000 * 119 / 101) and rows[-1].trades == 1 and abs(rows[-1].cash) < 1e-6
    equity, trades = backtest.hold(market, "h")
    assert [r.equity for r in equity.orderBy("date").collect()] == pytest.approx([r.equity for r in rows])
    bench = {r.date: r.benchmark_value for r in backtest.benchmark(market, "A").collect()}
    assert [bench[r.date] for r in rows] == pytest.approx([r.equity for r in rows])
    (m,) = backtest.with_alpha(backtest.metrics(equity.withColumns({"drawdown": F.lit(0.0), "trades": F.lit(1), "wins": F.lit(0)})), equity, backtest.benchmark(market, "A")).collect()
    assert m.alpha == pytest.approx(0, abs=1e-9) and m.benchmark_return == pytest.approx((119 / 101 - 1) * 100)
    (v,) = backtest.verdict(spark.createDataFrame([(5.0, 1.0), (6.0, 2.0), (-1.0, -0.5), (7.0, 1.0)], "total_return double, alpha double")).collect()
    assert (v.folds, v.positive, v.beating, v.verdict) == (4, 3, 3, "ROBUST")


def test_net_of_taxes(spark):
    trades = spark.createDataFrame([("r", "A", "BUY", 1000.0, 1.0, 0.0), ("r", "A", "SELL", 1500.0, 1.5, 500.0), ("r", "G", "SELL", 800.0, 1.0, 200.0), ("r", "A", "SELL", 10.0, 0.0, -100.0)], "run_id string, symbol string, side string, gross double, fees double, pnl double")
    equity = spark.createDataFrame([("r", "2025-01-01", 100_000.0), ("r", "2026-01-01", 102_000.0)], "run_id string, date string, equity double").withColumn("date", F.to_date("date"))
    (r,) = backtest.net_analysis(trades, equity, assets_of(spark, ("A", "stock"), ("G", "bond"))).collect()
    assert (r.taxable, r.tax, r.commission) == (600, pytest.approx(400 * 0.26 + 200 * 0.125), 3.5)
    assert r.slippage == pytest.approx(3310 * 0.0005) and r.stamp_duty == pytest.approx(101_000 * 0.002 * 365 / 365.25)
    assert r.net_final == pytest.approx(102_000 - r.tax - r.slippage - r.stamp_duty) and r.effective_rate == pytest.approx(r.tax / 6)
    (t,) = backtest.trade_measures(trades).collect()
    assert (t.win_rate, t.profit_factor) == (pytest.approx(200 / 3), 7)
