"""Paper accounts against plain Python, and small cases of scans, summaries and demonstration rows."""

import random

import pytest

from quantloom.functions import text
from quantloom.operators import account, learning
from quantloom.sources import demo, tables

SCHEMA = "account string, seq long, symbol string, side string, quantity double, price double, fees double"


def plain(orders, initial, fee):
    """status, cash, held, average, invested, realized of each order by (account, seq)."""
    cash, book, out = {}, {}, {}
    for a, n, s, side, q, p, f in sorted(orders, key=lambda o: (o[0] or "", o[1])):
        cash.setdefault(a, initial)
        held, average, invested = book.get((a, s), (0.0, 0.0, 0.0))
        status, gain = "SIMULATED", 0.0
        if p is None or q is None or q <= 0 or side not in ("BUY", "SELL"):
            status = "INVALID"
        else:
            f = q * p * (fee / 100) if f is None else f
            if side == "BUY" and cash[a] < q * p + f:
                status = "NO_CASH"
            elif side == "SELL" and held < q:
                status = "NO_HOLDING"
            elif side == "BUY":
                held, invested = held + q, invested + q * p + f
                average = invested / held
                cash[a] -= q * p + f
            else:
                gain = (p - average) * q - f
                held -= q
                cash[a] += q * p - f
                invested = max(0.0, invested - average * q) if held > 0 else 0.0
        if status == "SIMULATED":
            book[a, s] = held, average, invested
        out[a, n] = status, cash[a], held, average, invested, gain
    return out


def some_orders(n):
    rng = random.Random(7)
    return [
        (rng.choice(["a", "b", "hot", "hot", "hot", None]), k, rng.choice(["X", "Y", None]), rng.choice(["BUY", "BUY", "SELL", "SELL", "GIFT"]), rng.choice([1.0, 2.5, 10.0, 0.0, None]), rng.choice([9.5, 20.0, 31.25, None]), rng.choice([0.0, 1.5, None]))
        for k in range(n)
    ]


def test_account_equals_plain_python_over_batches(spark):
    orders = some_orders(3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = account.execute(spark.createDataFrame(orders, SCHEMA).repartition(3), 500.0, 0.2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(orders, 500.0, 0.2)
    assert len(got) == len(orders) and {r.status for r in got} == {"SIMULATED", "NO_CASH", "NO_HOLDING", "INVALID"}
    for r in got:
        status, *numbers = want[r.account, r.seq]
        assert r.status == status and [r.cash, r.held, r.average_price, r.invested, r.realized] == pytest.approx(numbers)


def test_worked_account(spark):
    rows = [("a", 1, "X", "BUY", 10.0, 50.0, 1.0), ("a", 2, "X", "BUY", 100.0, 50.0, 1.0), ("a", 3, "X", "SELL", 4.0, 60.0, 2.0), ("a", 4, "X", "SELL", 7.0, 60.0, 0.0), ("a", 5, "X", "SELL", 6.0, 60.0, None)]
    done = account.execute(spark.createDataFrame(rows, SCHEMA), 1000.0, 1.0)
    got = {r.seq: r for r in done.collect()}
    assert [got[k].status for k in range(1, 6)] == ["SIMULATED", "NO_CASH", "SIMULATED", "NO_HOLDING", "SIMULATED"]
    assert got[1].cash == 499.0 and got[1].average_price == pytest.approx(50.1)
    assert got[3].realized == pytest.approx((60 - 50.1) * 4 - 2) and got[3].cash == pytest.approx(737.0) and got[3].invested == pytest.approx(300.6)
    assert got[5].held == 0 and got[5].invested == 0 and got[5].cash == pytest.approx(737 + 360 - 3.6)
    assert account.holdings(done).count() == 0
    assert [(r.place, r.seq) for r in account.snapshots(done, 2).orderBy("place").collect()] == [(1, 3), (2, 5)]


def test_no_orders(spark):
    done = account.execute(spark.createDataFrame([], SCHEMA), 1.0)
    assert done.collect() == [] and account.holdings(done).collect() == [] and account.snapshots(done).collect() == []


def test_scans_prefer_the_rows_they_should(spark):
    rows = spark.sql("SELECT * FROM VALUES ('x', DATE'2024-01-01', 1.0D, true, 1), ('x', DATE'2024-01-01', 2.0D, false, 2), ('x', DATE'2024-01-01', 3.0D, false, 3), ('x', DATE'2024-01-02', 4.0D, true, 4), ('y', DATE'2024-01-01', null, true, 5) AS t(symbol, date, close, is_real, id)")
    assert [(r.symbol, r.close) for r in tables.one_a_date(rows).orderBy("date").collect()] == [("x", 3.0), ("x", 4.0)]
    assert tables.scan_prices(rows, [" X"], "2024-01-01").count() == 3 and tables.scan_prices(rows, [], "2024-01-01").count() == 0


def test_summaries_of_nothing(spark):
    merged = spark.createDataFrame([], "symbol string, action string")
    (r,) = tables.refresh_summary(spark.createDataFrame([("x",)], "symbol string"), merged).collect()
    assert r.asDict() == {"requested": 1, "updated": 0, "fallback": 1, "rows_inserted": 0, "rows_updated": 0}
    (r,) = tables.cache_stats(spark.createDataFrame([("2024-01-02T00:00:00",), ("2023-01-01 00:00:00",), ("x",), (None,)], "expires_at string"), "2024-01-01 00:00:00").collect()
    assert (r.entries, r.valid, r.expired) == (4, 1, 3)
    (r,) = text.market_mood(spark.createDataFrame([], "score double, label string, impact string, published_at date"), "2024-01-01").collect()
    assert (r.news_count, r.average_sentiment, r.sentiment_label, r.impact_level) == (0, 0.0, "NEUTRAL", "LOW")


def test_demo_news_and_universe(spark):
    assets = spark.createDataFrame([("ab", "stock"), (None, "etf")], "symbol string, asset_type string")
    rows = demo.news(assets, "2024-03-01").orderBy("place").collect()
    assert [r.published_at.isoformat() for r in rows] == ["2024-03-01T12:00:00", "2024-03-01T05:00:00", "2024-02-29T22:00:00"]
    assert rows[0].title.startswith("AB ") and rows[2].url == "demo://news/ab/2"
    bars = spark.createDataFrame([("ab",), ("ab",)], "symbol string")
    assert [r.symbol for r in learning.universe(bars, assets).collect()] == ["AB"]
    assert [r.symbol for r in learning.universe(bars, assets, (" zz", "ab", "ZZ", ""), 3).collect()] == ["ZZ", "AB"]
