"""Normalisers, imports, merges and exports on small inputs."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from quantloom.functions import text
from quantloom.plans import feeds
from quantloom.sources import holdings, responses, tables


def bodies(spark, *values, symbol="SPY"):
    return spark.createDataFrame([(symbol, v if isinstance(v, str) or v is None else json.dumps(v)) for v in values], "symbol string, body string")


def test_daily_prices(spark):
    good = {"1. open": "1", "2. high": "3", "3. low": "0.5", "4. close": "2"}
    series = {"2026-01-02": good | {"5. volume": "7"}, "2026-01-03": good | {"5. adjusted close": "1.9", "5. volume": "7", "6. volume": "8"}, "2026-01-04": {"4. close": "100"}, "2026-01-05": good | {"4. close": "x"}, "2026-01-06": good | {"5. adjusted close": ""}, "2026-01-07": None}
    got = sorted(tuple(r) for r in responses.daily_prices(bodies(spark, {"Time Series (Daily)": series}, {"Note": "limit"}, "no json", None, "")).collect())
    assert [(str(r[1]), *r[5:]) for r in got] == [("2026-01-02", 2, 2, 7), ("2026-01-03", 2, 1.9, 8), ("2026-01-06", 2, 2, 0)]


def test_ticks(spark):
    day = 86_400_000
    body = {"prices": [[day, 5], [day + 1, 9], [day + 2, 3], [2 * day, 4], [3 * day], ["x", 1]], "total_volumes": [[day, 10], [day + 5, 20], [2 * day, None]]}
    got = sorted(tuple(r) for r in responses.ticks(bodies(spark, body, {"prices": "none"}, {})).collect())
    assert [(str(r[1]), *r[2:]) for r in got] == [("1970-01-02", 5, 9, 3, 3, 3, 20), ("1970-01-03", 4, 4, 4, 4, 4, 0)]


def test_observations(spark):
    body = {"observations": [{"date": "2026-01-01", "value": "4.5"}, {"date": "2026-01-02", "value": "."}, {"date": "2026-01-03", "value": None}, {"date": "2026-01-04", "value": "n/a"}, {"date": "2026-01-05"}]}
    got = responses.observations(bodies(spark, body, {"observations": 3})).collect()
    assert [(str(r.date), r.open, r.high, r.low, r.close, r.volume) for r in got] == [("2026-01-01", 4.5, 4.5, 4.5, 4.5, 0)]


def test_scored_news(spark):
    ticker = lambda t, s, label, r: {"ticker": t, "ticker_sentiment_score": s, "ticker_sentiment_label": label, "relevance_score": r}
    feed = [
        {"title": " A ", "url": " ", "time_published": "20260102T030405", "overall_sentiment_score": 0.9, "ticker_sentiment": [ticker("X", "0.1", "Neutral", "1"), ticker("spy", "-3", "Somewhat-Bearish", "0.4")]},
        {"title": "B", "overall_sentiment_score": "0.2", "overall_sentiment_label": "", "time_published": "2026-01-02 03:04:05"}, {"title": "C", "overall_sentiment_score": "bad", "time_published": "soon", "ticker_sentiment": [ticker("SPY", "0.5", "POSITIVE", "150")]}, {"title": " "}, {},
    ]
    got = sorted(responses.scored_news(bodies(spark, {"feed": feed}, {"feed": None}, {})).collect(), key=lambda r: r.title)
    assert [(r.title, r.url, r.score, r.label, r.relevance) for r in got] == [("A", None, -1.0, "NEGATIVE", 40.0), ("B", None, 0.2, "POSITIVE", 50.0), ("C", None, 0.5, "POSITIVE", 100.0)]
    assert [str(r.published_at) for r in got] == ["2026-01-02 03:04:05", "2026-01-02 03:04:05", "None"]


def test_plain_news(spark):
    articles = [{"headline": "Earnings beat", "summary": "and revenue growth", "url": "u", "source": "s", "datetime": 86_400}, {"headline": "  ", "summary": "x"}, {"headline": "Update", "datetime": 0}, {"headline": "Late", "datetime": "no"}]
    got = {r.title: r for r in responses.plain_news(bodies(spark, {"articles": articles}, {"articles": {}})).collect()}
    assert set(got) == {"Earnings beat", "Update", "Late"} and got["Earnings beat"].label == "POSITIVE" and got["Earnings beat"].relevance == 75
    assert str(got["Earnings beat"].published_at) == "1970-01-02 00:00:00" and got["Update"].published_at is None and got["Update"].score == 0


def test_sentiment_and_impact(spark):
    rows = spark.createDataFrame([("Earnings beat and revenue growth support a dividend increase.",), ("Guidance cut follows an investigation and revenue decline.",), ("",), (None,)], "t string")
    got = [(r.s.score, r.s.label) for r in rows.select(text.sentiment(F.col("t")).alias("s")).collect()]
    assert got == [(1.0, "POSITIVE"), (-1.0, "NEGATIVE"), (0.0, "NEUTRAL"), (0.0, "NEUTRAL")]
    items = spark.createDataFrame([(90.0, 0.7, 2), (55.0, 0.2, 0), (20.0, 0.0, 0), (65.0, -0.55, 0), (80.0, 0.0, 1), (None, None, 0)], "r double, s double, k int")
    assert [r[0] for r in items.select(text.impact(F.col("r"), F.col("s"), F.col("k"))).collect()] == ["HIGH", "MEDIUM", "LOW", "HIGH", "HIGH", "LOW"]


def test_numbers(spark):
    said = {"383.47": 383.47, "383,47": 383.47, "1,234.56": 1234.56, "1.234,56": 1234.56, "€ 383,47": 383.47, "$ 1,000.00": 1000.0, "": 0.0, "1.234.567": 1234567.0, "1,234,567": 1234567.0, "383.47.00": None, "abc": None, "12d": None, "5f": None, "NaN": None, "Infinity": None, "-inf": None, "1e400": None, "0x1F": None, "-1.5e3": -1500.0, ".5": 0.5, "+7": 7.0}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", text.parse_number(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == said
    assert spark.range(1).select(text.parse_number(F.lit(None).cast("string"))).first()[0] == 0.0


def test_labels(spark):
    said = {"POSITIVE_RETURN": 1, "NON_POSITIVE_RETURN": 1, "OUTPERFORM": 1, "UNDERPERFORM": -1, "DRAWDOWN_RISK": -1, "LOW_DRAWDOWN_RISK": -1, "HOLD": 0, "": 0}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", text.encode_label(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == said


def test_holdings_files(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('symbol,quantity,average_price,currency\naapl,10,"1,234.56",usd\n,5,1,\nmsft,0,1,\n')
    assert [tuple(r) for r in holdings.read_holdings(spark, str(path)).collect()] == [("AAPL", "AAPL", "stock", 10.0, 1234.56, "USD", None)]
    path.write_text("Simbolo,Quantità,Prezzo medio,Tipo\nvwce,12,\"101,5\",ETF\nbad,x,1,ETF\n\n")
    got = {r.symbol: (r.quantity, r.average_price, r.asset_type, r.currency, r.error) for r in holdings.read_holdings(spark, str(path)).collect()}
    assert got == {"VWCE": (12.0, 101.5, "etf", "EUR", None), "BAD": (None, 1.0, "etf", "EUR", "not a number: quantity")}
    with pytest.raises(ValueError, match="missing columns: symbol, quantity, average_price"):
        holdings.columns_of(["foo", "bar"])
    held = spark.createDataFrame([("A", "a", "stock", "EUR", None), ("N", "n", "etf", "USD", None), ("N", "n", "etf", "USD", None), ("X", "x", "etf", "USD", "bad")], "symbol string, name string, asset_type string, currency string, error string")
    assert [tuple(r) for r in holdings.missing_assets(held, spark.createDataFrame([("a",)], "symbol string")).collect()] == [("N", "n", "etf", "USD", "medium")]


def test_price_upsert_twice(spark):
    old = spark.createDataFrame([("A", "d1", 1.0, False, 1), ("A", "d1", 2.0, True, 2), ("A", "d2", 3.0, False, 3), ("A", "d2", 4.0, False, 4), ("B", "d1", 5.0, False, 5)], "symbol string, date string, close double, is_real boolean, id long")
    new = spark.createDataFrame([("A", "d1", 10.0, 1), ("A", "d1", 11.0, 2), ("A", "d3", 12.0, 3), (None, "d3", 1.0, 4)], "symbol string, date string, close double, seq int")
    once = tables.upsert_prices(old, new)
    got = sorted((r.symbol, r.date, r.close, r.id or 0, r.action) for r in once.collect())
    assert got == [("A", "d1", 11.0, 2, "updated"), ("A", "d2", 3.0, 3, "kept"), ("A", "d2", 4.0, 4, "kept"), ("A", "d3", 12.0, 0, "inserted"), ("B", "d1", 5.0, 5, "kept")]
    again = tables.upsert_prices(once.drop("action"), new).groupBy("action").count().collect()
    assert {r.action: r["count"] for r in again} == {"updated": 2, "kept": 3}


def test_news_upsert_twice(spark):
    schema = "symbol string, url string, title string, published_at string, seq int"
    new = spark.createDataFrame([("A", "u", "t", "p", 1)], schema)
    once = tables.upsert_news(new.drop("seq").withColumn("id", F.lit(1)).limit(0), new)
    assert [r.action for r in once.collect()] == ["inserted"]
    again = tables.upsert_news(once.drop("action").withColumn("id", F.lit(1)), spark.createDataFrame([("A", "u", "t2", "q", 1), ("A", None, "t", "p", 2), ("A", "w", "z", None, 3), ("A", "w", "y", None, 4)], schema))
    assert sorted((r.id or 0, r.url or "", r.title, r.action) for r in again.collect()) == [(0, "w", "y", "inserted"), (1, "", "t", "updated")]


def test_table_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 5), ("c", 6), ("c", 7)], "k string, v int")
    added, refused = tables.insert_new(old, new, "k")
    assert [tuple(r) for r in added.collect()] == [("c", 6)] and sorted(tuple(r) for r in refused.collect()) == [("b", 5), ("c", 7)]
    assert sorted(tuple(r) for r in tables.last_wins(old, new.where("v < 7"), "k").collect()) == [("a", 1), ("b", 5), ("c", 6)]
    left = tables.delete_cascade(new, "k", old, new)
    assert [t.count() for t in left] == [1, 0]
    counts = tables.count_up(spark.createDataFrame([("p", 3)], "k string, calls_count long"), spark.createDataFrame([("p",), ("q",), ("p",)], "k string"), "k")
    assert sorted(tuple(r) for r in counts.collect()) == [("p", 5), ("q", 1)]
    filled = tables.backfill(spark.createDataFrame([("a", None), ("b", 9)], "k string, v int"), old, "k", v=F.col("v"))
    assert sorted(tuple(r) for r in filled.collect()) == [("a", 1), ("b", 9)]


def test_exports(spark, sf, tmp_path):
    from quantloom.plans import books, views

    reports = {"portfolio": (tables.portfolio_export(books.valued(spark, sf)), 10), "orders": (tables.orders_export(views.orders(spark, sf)), 10), "tax": (tables.tax_export(books.events(spark, sf)), 11)}
    for name, (rows, width) in reports.items():
        tables.write_csv(rows, str(tmp_path / name), one_file=True)
        (file,) = glob.glob(f"{tmp_path}/{name}/*.csv")
        lines = list(csv.reader(open(file)))
        assert lines[0] == rows.columns and len(lines[0]) == width and len(lines) == rows.count() + 1


def test_news_lists_are_bounded(spark):
    rows = spark.range(300).select(F.col("id").alias("item_id"), F.lit("A").alias("symbol"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("published_at"), F.lit("LOW").alias("impact"))
    assert feeds.news_list(rows, most=1000).count() == 200 and feeds.news_list(rows, most=0).count() == 1 and feeds.news_list(rows, impact="high").count() == 0
    assert [r.item_id for r in feeds.news_list(rows, "a", most=2).collect()] == [299, 298]


def test_layouts_of_two_generations(spark):
    old = spark.createDataFrame([(1, 5.0), (2, None)], "id int, score double")
    new = spark.createDataFrame([(3, None, 9.0), (4, 1.0, 2.0)], "id int, score double, final_score double")
    got = tables.layouts([old, new], id=("id",), value=("final_score", "score"))
    assert sorted(map(tuple, got.collect())) == [(1, 5.0), (2, None), (3, 9.0), (4, 2.0)]
    with pytest.raises(ValueError, match="other"):
        tables.layouts([old], value=("score", "other"))


def test_a_sheets_numbers_are_read_once(spark):
    """As columns that conditions were pushed under, the numbers took so much code that it couldn't be compiled."""
    rows = spark.createDataFrame([(["x", "1.234,5", "2,5"],), (["y", "1..2,3,4", "1"],), (["z", "-1", "1"],)], "cells array<string>")
    out = holdings.holdings(rows, ["symbol", "quantity", "average_price"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 2
    assert [(r.symbol, r.quantity, r.average_price, r.error) for r in out.orderBy("symbol").collect()] == [("X", 1234.5, 2.5, None), ("Y", None, 1.0, "not a number: quantity")]
