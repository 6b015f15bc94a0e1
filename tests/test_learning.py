"""Ranks and areas, carried values, boosted trees, features as of a date and the registry against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
import sqlcheck
from pyspark.sql import functions as F

from quantloom.functions import text
from quantloom.operators import boosting, learning, ranks, registry, scan
from quantloom.plans import catalog
from quantloom.plans import learning as plans
from quantloom.sources.publish import Store


def test_places(spark):
    rows = spark.createDataFrame([(x % 7, x) for x in random.Random(1).sample(range(900), 500)], "a int, b int")
    got = [(r.a, r.b) for r in ranks.numbered(rows, "place", "a", "b").orderBy("place").collect()]
    assert got == sorted(got) and len(got) == 500
    assert sorted(r.place for r in ranks.numbered(rows, "place", "a", "b").collect()) == list(range(1, 501))
    assert ranks.numbered(rows.limit(0), "place", "a").isEmpty()


@pytest.mark.parametrize("chunk", [scan.CHUNK, 5])
def test_areas(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 1), rng.choice([0.5, round(rng.random(), 2)])) for k in "abc" for _ in range(300)]
    rows += [("one kind", 1, 0.2), ("one kind", 1, 0.4), ("nothing", None, 0.1), ("nothing", 1, None), ("tied", 0, 0.5), ("tied", 1, 0.5)]
    got = {r.of: r.area for r in ranks.areas(spark.createDataFrame(rows, "of string, target int, probability double"), "of").collect()}
    for k in ("a", "b", "c", "tied"):
        pos, neg = [p for o, y, p in rows if o == k and y == 1], [p for o, y, p in rows if o == k and y == 0]
        assert got[k] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)), abs=1e-12)
    assert got["one kind"] is None and "nothing" not in got
    assert learning.auc(spark.createDataFrame([], "target int, probability double")) is None


@pytest.mark.parametrize("chunk", [scan.CHUNK, 10])
def test_carried(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(k, t, rng.choice([None, None, None, rng.random()]), rng.choice([None, "x", "y"])) for k in "ab" for t in range(200)]
    got = {(r.k, r.t): (r.v, r.w) for r in scan.carried(spark.createDataFrame(rows, "k string, t int, v double, w string"), "k", ["v", "w"], "t").collect()}
    for k in "ab":
        v = w = None
        for _, t, x, y in (r for r in rows if r[0] == k):
            v, w = x if x is not None else v, y if y is not None else w
            assert got[k, t] == (v, w)


def plain_boosting(x, y, w, edges, rounds, depth, rate, l2, least):
    """The same trees, grown by loops; returns raw sums of the training rows."""
    bins = np.array([[-1 if math.isnan(v) else int(np.searchsorted(edges[j], v, side="right")) for j, v in enumerate(r)] for r in x])
    share = (w * y).sum() / w.sum()
    f = np.full(len(y), math.log(share / (1 - share)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (p - y), w * p * (1 - p)
        add = np.zeros(len(y))

        def grow(rows, level):
            score = lambda s: g[s].sum() ** 2 / (h[s].sum() + l2)  # noqa: B023, E731
            best = None
            for j in range(x.shape[1]) if level < depth else ():
                at, lost = bins[rows, j], bins[rows, j] < 0
                for b in sorted(set(at[~lost])):
                    for missing in (False, True):
                        left = ((at <= b) & ~lost) | (lost & missing)
                        if not lost.any() and missing != (2 * left.sum() >= len(rows)):
                            continue
                        a, c = rows[left], rows[~left]
                        if len(a) < least or len(c) < least:
                            continue
                        gain = score(a) + score(c) - score(rows)
                        if gain > 1e-12 and (best is None or (round(gain, 9), -j, -b, missing) > best[0]):
                            best = ((round(gain, 9), -j, -b, missing), a, c)
            if best is None:
                if level:
                    add[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)  # noqa: B023
                return
            grow(best[1], level + 1)
            grow(best[2], level + 1)

        grow(np.arange(len(y)), 0)
        f = f + add
    return f


def test_boosting_equals_plain(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3)).round(2)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 2] = np.where(rng.random(240) < 0.5, 1.0, x[:, 2])
    y = (np.nan_to_num(x[:, 0]) * 2 + np.isnan(x[:, 1]) + rng.normal(0, 0.5, 240) > 0.3).astype(int)
    w = np.where(y == 1, 1.5, 0.75)
    cols = ["a", "b", "c"]
    rows = spark.createDataFrame([(k, *[None if math.isnan(v) and k % 2 else float(v) for v in r], int(t), float(u)) for k, (r, t, u) in enumerate(zip(x, y, w))], "k int, a double, b double, c double, target int, weight double")
    edges = [[-1.0, -0.5, 0.0, 0.5, 1.0], [-0.7, 0.1, 0.9], []]
    model = boosting.fit(rows, cols, weight="weight", rounds=12, depth=3, rate=0.2, least=8, edges=edges)
    want = plain_boosting(x, y, w, edges, 12, 3, 0.2, 1.0, 8)
    got = {r.k: r.probability for r in boosting.predict(model, rows.withColumn("bins", F.lit("own"))).collect()}
    assert len(model.trees) == 12
    assert [got[k] for k in range(240)] == pytest.approx(list(1 / (1 + np.exp(-want))), abs=1e-9)
    assert np.mean([(got[k] >= 0.5) == (y[k] == 1) for k in range(240)]) > 0.8


def test_boosting_edges(spark):
    rows = spark.createDataFrame([(float(k % 10), None if k % 3 else float("inf"), k % 2) for k in range(100)], "a double, b double, target int")
    (a, b) = boosting.edges_of(rows, ["a", "b"], 8)
    assert a == sorted(set(a)) and len(a) <= 7 and b == []
    model = boosting.fit(rows, ["a", "b"], rounds=2, bins=8)
    assert 0 < boosting.predict(model, rows).first().probability < 1
    with pytest.raises(ValueError, match="one kind"):
        boosting.fit(rows.where("target = 1"), ["a"], rounds=1)
    with pytest.raises(ValueError, match="one kind"):
        boosting.fit(rows.limit(0), ["a"], rounds=1)


def test_as_of(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 20)
    rng, day = random.Random(7), lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    names = [*learning.PRICE_FEATURES, *learning.NEWS_FEATURES]
    bars = [(s, day(k), *[float(k)] * len(names)) for s in ("A", "b") for k in range(5, 60, 3)]
    weights = [(rng.choice("aB"), day(rng.randint(0, 60)), n, rng.choice([None, float(n)])) for n in range(40)]
    said = [(rng.choice("ab"), day(rng.randint(0, 60)), n, rng.choice([*plans.SAID, None])) for n in range(40)]
    asked = [(s, day(k)) for s in ("a", "B", "c") for k in range(0, 70, 4)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = learning.as_of(
        frame(asked, "symbol string, date date"), frame(bars, "symbol string, date date, " + ", ".join(f"{n} double" for n in names)),
        frame(weights, "symbol string, date date, seq int, weight double"), frame(said, "symbol string, date date, seq int, label string"),
    )
    code = {r.label: float(r.v) for r in frame([(x,) for x in plans.SAID], "label string").select("label", text.encode_label(F.col("label")).alias("v")).collect()}
    got = {(r.symbol, r.date): r for r in out.collect()}

    def last(log, s, d):
        rows = [r for r in log if r[0].upper() == s and r[1] <= d]
        return max(rows, key=lambda r: r[1:3])[3] if rows else None

    want = 0
    for s, d in ((s.upper(), d) for s, d in asked):
        known = [b[1] for b in bars if b[0].upper() == s and b[1] <= d]
        if not known:
            assert (s, d) not in got
            continue
        r, want = got[s, d], want + 1
        assert r.feature_date == max(known) and r.rsi_14 == (max(known) - day(0)).days
        assert r.portfolio_weight == (last(weights, s, d) or 0.0) and r.last_label == code.get(last(said, s, d), 0.0)
    assert len(got) == want > 20


def test_registry(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert registry.status(store).models == 0 and registry.model(store) is None
    with pytest.raises(ValueError, match="no such model"):
        registry.load(store)
    about = lambda name, at: spark.createDataFrame([(name, "LOGISTIC_REGRESSION", at)], "name string, model_type string, trained_at string")
    run = spark.createDataFrame([("train", 10), ("test", 5)], "part string, rows int")
    for k, (name, at) in enumerate((("old", "2024-01-01"), ("tied", "2024-02-01"), ("late", "2024-02-01"), ("older", "2023-01-01")), 1):
        registry.save(store, k, about(name, at), run)
    assert [r.name for r in registry.models(store).orderBy("place").collect()] == ["late", "tied", "old", "older"] and registry.model(store).id == 3 and registry.model(store, 2).name == "tied" and registry.model(store, 9) is None
    registry.save(store, 4, about("again", "2025-01-01"), run)
    assert registry.model(store).name == "again" and registry.status(store).models == 4 and registry.training_runs(store).count() == 8
    with pytest.raises(ValueError, match="no fitted stages"):
        registry.load(store)
    log = lambda a, b: spark.createDataFrame([("ab" if n % 2 else "AB", f"2024-01-{n % 5 + 1:02}", n) for n in range(a, b)], "symbol string, created_at string, id int")
    for batch, rows in (("x", log(0, 80)), ("y", log(80, 120)), ("y", log(80, 120))):
        registry.add_predictions(store, batch, rows)
    rows = registry.predictions(store)
    assert rows.count() == 120 == registry.status(store).predictions
    assert registry.recent_predictions(rows, 500).count() == 50 and registry.recent_predictions(rows, 0, "Ab").count() == 1 and registry.recent_predictions(rows, 5, "zz").isEmpty()
    order = sorted(((f"2024-01-{n % 5 + 1:02}", n) for n in range(120)), reverse=True)
    assert [r.id for r in registry.recent_predictions(rows, 10).orderBy("place").collect()] == [n for _, n in order[:10]]


def test_a_data_set_makes_its_bars_once(spark, sf):
    from quantloom.plans import learning as plans

    plan = plans.data(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "bars-" not in plan and "l_extendedprice" not in plan  # nothing in it goes back to the order lines


def test_a_prediction_keeps_what_was_known(spark):
    rng, day, names = random.Random(11), dt.date(2024, 1, 8), [*learning.PRICE_FEATURES, *learning.NEWS_FEATURES]
    schema = "symbol string, date date, " + ", ".join(f"{n} double" for n in names)
    rows = [("A", day, *[rng.random() for _ in names]) for _ in range(40)]
    model = learning.train(spark.createDataFrame([(*r, int(r[2] > 0.5)) for r in rows], schema + ", target int").withColumns({c: F.lit(0.0) for c in learning.OWN_FEATURES}))
    bars = spark.createDataFrame([("a", day, None, *[0.5] * (len(names) - 1)), ("B", day, *[0.25] * len(names))], schema)
    weights = spark.createDataFrame([("A", day, 0, 12.5)], "symbol string, date date, seq int, weight double")
    log = spark.createDataFrame([("a", day, 1, "UNDERPERFORM"), ("b", day + dt.timedelta(9), 1, "OUTPERFORM")], "symbol string, date date, seq int, label string")
    asked = bars.select("symbol", F.date_add("date", 2).alias("date"))
    with_logs, without = ({r.symbol: r for r in learning.say(model, learning.as_of(asked, bars, w, p), "POSITIVE_RETURN", 0.9, 0.9).collect()} for w, p in ((weights, log), (weights.limit(0), log.limit(0))))
    a, b = with_logs["A"], with_logs["B"]
    assert (a.feature_date, a.features.portfolio_weight, a.features.last_label, tuple(a.said)) == (day, 12.5, -1.0, (day, "UNDERPERFORM"))
    assert (b.feature_date, b.features.portfolio_weight, b.features.last_label, b.said) == (day, 0.0, 0.0, None)  # the label is of a later day
    assert sorted(a.features.asDict()) == sorted(learning.FEATURES) and a.features[names[0]] is None and b.features[names[0]] == 0.25
    assert a != without["A"] and a.probability == without["A"].probability and b == without["B"]


def test_predictions_keep_the_weight_held_and_what_was_said(spark, sf):
    rows = plans.ml_predictions(spark, sf).collect()
    cols, held = sqlcheck.of_duck(catalog.SQL["portfolio_valuation"], sf)
    weight = {r[cols.index("symbol")].upper(): r[cols.index("weight")] for r in held}
    assert len(rows) == 25 and sum(weight.values()) > 0
    for r in rows:
        assert r.feature_date == r.date and r.features.portfolio_weight == pytest.approx(weight.get(r.symbol, 0.0), abs=1e-4)
        assert r.features.last_label == 1 and r.said.label in learning.LABELS["POSITIVE_RETURN"]  # either label has POSITIVE in it
        assert (r.date.year - r.said.date.year) * 12 + r.date.month - r.said.date.month == 3
