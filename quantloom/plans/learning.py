"""Queries of model data sets, splits and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import boosting, indicators, learning, portfolio, ranks, registry
from quantloom.sources import scratch

from . import views
from .catalog import NEWS, OSC, TREND, W1, _news, query
from .records import _store
from .technical import MORE, REC

FEATURES = f"""{REC}, {TREND}, {OSC}, {MORE}, g0 AS (SELECT osc.symbol, osc.date, osc.close, osc.rsi_14, osc.atr_14, osc.roc_12, t.sma_50, t.sma_200, ri.macd_line, ri.macd_histogram, ri.adx_14, more.volatility_30, more.percent_b, more.volume_ratio_20
        FROM osc JOIN t USING (symbol, date) JOIN more USING (symbol, date) JOIN ri USING (symbol, date)),
    g1 AS (SELECT *, close / lag(close, 1) OVER {W1} - 1 AS return_1, close / lag(close, 5) OVER {W1} - 1 AS return_5, close / lag(close, 20) OVER {W1} - 1 AS return_20, close / sma_50 - 1 AS price_vs_sma50, close / sma_200 - 1 AS price_vs_sma200, sma_50 / sma_200 - 1 AS sma50_vs_sma200,
        CASE WHEN count(close) OVER v >= 20 THEN close / max(close) OVER v - 1 END AS max_drawdown_recent FROM g0 WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)),
    g2 AS (SELECT *, 30 + CASE WHEN price_vs_sma50 > 0 THEN 25 ELSE 0 END + CASE WHEN price_vs_sma200 > 0 THEN 25 ELSE 0 END + CASE WHEN sma50_vs_sma200 > 0 THEN 20 ELSE 0 END AS trend_score,
        greatest(0, least(100, 45 + CASE WHEN rsi_14 BETWEEN 40 AND 65 THEN 25 ELSE 0 END + CASE WHEN macd_histogram > 0 THEN 20 ELSE 0 END + CASE WHEN roc_12 > 0 THEN 10 ELSE 0 END - CASE WHEN rsi_14 > 75 OR rsi_14 < 25 THEN 20 ELSE 0 END)) AS momentum_score,
        greatest(0, least(100, 100 - coalesce(volatility_30, .3::DOUBLE) * 100 + coalesce(max_drawdown_recent, -.2::DOUBLE) * 80)) AS volatility_score, 50 + greatest(-1, least(1, coalesce(volume_ratio_20, 1) - 1)) * 25 AS volume_score,
        greatest(0, least(100, 65 - abs(coalesce(percent_b, .5::DOUBLE) - .5::DOUBLE) * 45)) AS support_resistance_score, greatest(0, least(100, coalesce(volatility_30, .25::DOUBLE) * 55 + abs(coalesce(max_drawdown_recent, -.15::DOUBLE)) * 120)) AS risk_penalty FROM g1),
    feat AS (SELECT *, greatest(0, least(100, trend_score * .3::DOUBLE + momentum_score * .25::DOUBLE + volatility_score * .15::DOUBLE + volume_score * .1::DOUBLE + support_resistance_score * .1::DOUBLE - risk_penalty * .1::DOUBLE)) AS technical_score FROM g2)"""
NAMES = learning.PRICE_FEATURES


@query("ml_features", f"WITH RECURSIVE {FEATURES} SELECT symbol, date, {', '.join(f'round({c}, 3)::DOUBLE AS {c}' for c in NAMES)} FROM feat", "prices")
def ml_features(spark, sf):
    return indicators.features(views.prices(spark, sf)).select("symbol", "date", *[F.round(c, 3).alias(c) for c in NAMES])


DATA = f"""{FEATURES}, {NEWS}, week AS (SELECT p.symbol, p.date, coalesce(avg(s.score), 0)::DOUBLE AS news_sentiment, coalesce(count_if(label = 'POSITIVE'), 0)::DOUBLE AS news_positive, coalesce(count_if(label = 'NEGATIVE'), 0)::DOUBLE AS news_negative, coalesce(count_if(impact = 'HIGH'), 0)::DOUBLE AS news_high_impact
        FROM prices p LEFT JOIN scored s ON s.symbol = p.symbol AND s.published_at > p.date - 7 AND s.published_at <= p.date GROUP BY p.symbol, p.date),
    ahead AS (SELECT symbol, date, lead(date, 4) OVER {W1} AS target_date, lead(close, 4) OVER {W1} / close - 1 AS future_return FROM prices),
    data AS (SELECT f.symbol, f.date, target_date, (future_return > 0)::INT AS target, future_return, {', '.join('f.' + c for c in NAMES)}, news_sentiment, news_positive, news_negative, news_high_impact FROM feat f JOIN week USING (symbol, date) JOIN ahead USING (symbol, date)
        WHERE future_return IS NOT NULL AND {' AND '.join(f'f.{c} IS NOT NULL' for c in NAMES)})"""


def data(spark, sf, target="POSITIVE_RETURN", benchmark=None, bars=None):
    """``bars`` are written first where none are given: features and targets each read them, and would make them of all order lines anew."""
    bars = scratch.keep(views.prices(spark, sf), "bars") if bars is None else bars
    return learning.dataset(bars, _news(spark, sf), target, 4, benchmark)


@query("ml_dataset", f"WITH RECURSIVE {DATA} SELECT symbol, date, target_date, target, {', '.join(f'round({c}, 3)::DOUBLE AS {c}' for c in [*NAMES, *learning.NEWS_FEATURES])}, 0.0::DOUBLE AS portfolio_weight, 0.0::DOUBLE AS last_label FROM data", "prices", "news")
def ml_dataset(spark, sf):
    return data(spark, sf).select("symbol", "date", "target_date", "target", *[F.round(c, 3).alias(c) for c in learning.FEATURES])


@query("ml_outperform", f"WITH RECURSIVE {DATA}, b AS (SELECT date, future_return AS br FROM ahead WHERE symbol = 'Brand#11' AND future_return IS NOT NULL) SELECT symbol, date, (future_return > br)::INT AS target FROM data JOIN b USING (date)", "prices", "news")
def ml_outperform(spark, sf):
    return data(spark, sf, "OUTPERFORM_BENCHMARK", "Brand#11").select("symbol", "date", "target")


@query("ml_time_split", f"WITH RECURSIVE {DATA}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM data)) SELECT symbol, date, CASE WHEN k < least(greatest(floor(n * .75), 1), n - 1) THEN 'train' ELSE 'test' END AS part FROM data JOIN d USING (date)", "prices", "news")
def ml_time_split(spark, sf):
    return learning.split_by_time(data(spark, sf).select("symbol", "date")).select("symbol", "date", "part")


@query("ml_folds", f"""WITH RECURSIVE {DATA}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM data)), f AS (SELECT unnest([1, 2, 3, 4]) AS fold)
    SELECT fold::INT AS fold, CASE WHEN k < n // 5 * fold THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM data JOIN d USING (date) CROSS JOIN f WHERE k < CASE WHEN fold < 4 THEN n // 5 * (fold + 1) ELSE n END GROUP BY ALL""", "prices", "news")
def ml_folds(spark, sf):
    return learning.expanding_folds(data(spark, sf).select("symbol", "date"), 4).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query("ml_lookahead", f"WITH RECURSIVE {DATA} SELECT symbol, date, target_date FROM data WHERE target_date <= date", "prices", "news")
def ml_lookahead(spark, sf):
    """Rows that would look ahead: none."""
    return learning.looks_ahead(data(spark, sf).select("symbol", "date", "target_date"))


@query("ml_logistic")
def ml_logistic(spark, sf):
    """Measures of a logistic regression on the last quarter of the dates."""
    parts = scratch.keep(learning.split_by_time(data(spark, sf)), "parts")
    model = learning.train(parts.where("part = 'train'"))
    told = learning.predict(model, parts.where("part = 'test'"))
    return learning.measures(told).withColumn("auc", F.lit(learning.auc(told)))


def _measured(spark, sf, fit):
    """Measures on the last quarter of the dates of what ``fit`` makes of the others: from (train, test) to predictions."""
    parts = scratch.keep(learning.split_by_time(data(spark, sf)), "parts")
    told = scratch.keep(fit(parts.where("part = 'train'"), parts.where("part = 'test'")).select("target", "probability"), "told")
    return learning.measures(told).withColumn("auc", F.lit(learning.auc(told)))


@query("ml_forest")
def ml_forest(spark, sf):
    """Measures of a random forest."""
    return _measured(spark, sf, lambda train, test: learning.predict(learning.train(train, "RANDOM_FOREST", trees=20), test))


@query("ml_boosted")
def ml_boosted(spark, sf):
    """Measures of a few rounds of trees boosted on histograms, both targets weighing alike."""
    return _measured(spark, sf, lambda train, test: boosting.predict(boosting.fit(learning.balanced(train), learning.FEATURES, weight="weight", rounds=5, rate=0.3), test))


@query("ml_permuted")
def ml_permuted(spark, sf):
    """How much each feature's values, dealt anew, cost a logistic regression."""
    parts = scratch.keep(learning.split_by_time(data(spark, sf)), "parts")
    ranked = learning.permutation_importances(learning.train(parts.where("part = 'train'")), parts.where("part = 'test'"), repeats=2)
    return spark.createDataFrame(ranked, "feature string, importance double")


SCORED = """s AS (SELECT unnest(['discount', 'tax', 'quantity', 'price']) AS name, unnest([l_discount * 10, l_tax * 12.5::DOUBLE, l_quantity / 50, l_extendedprice / 100000]) AS p, (l_returnflag = 'R')::INT AS y FROM lineitem)"""


@query("score_measures", f"""WITH {SCORED}, k AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY p) + (count(*) OVER (PARTITION BY name, p) - 1) / 2.0::DOUBLE AS place FROM s),
    m AS (SELECT name, count_if(y = 1)::BIGINT AS yes, count_if(y = 0)::BIGINT AS no, count_if(y = 1 AND p >= .5)::BIGINT AS tp, count_if(y = 0 AND p >= .5)::BIGINT AS fp, count_if(y = 1 AND p < .5)::BIGINT AS fn, count_if(y = 0 AND p < .5)::BIGINT AS tn, sum(place) FILTER (WHERE y = 1) AS places FROM k GROUP BY name)
    SELECT name, tp, fp, fn, tn, round((tp + tn) / (yes + no)::DOUBLE, 6) AS accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round((places - yes * (yes + 1) / 2::DOUBLE) / (yes::DOUBLE * no), 6) AS area FROM m""")
def score_measures(spark, sf):
    """Confusion counts and area under the curve of four given scores of a sale's return."""
    scores = {"discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 12.5, "quantity": F.col("l_quantity") / 50, "price": F.col("l_extendedprice") / 100_000}
    rows = views.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("target"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), x.alias("probability")) for n, x in scores.items()])))
    out = learning.measures(rows, "name").join(ranks.areas(rows, "name").select("name", "area"), "name")
    return out.select("name", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "area")])


#: A log of weights and one of labels: the order lines that are filled and those that are open.
SEQ = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
SAID = ("DRAWDOWN_RISK", "NON_POSITIVE_RETURN", "OUTPERFORM", "HOLD", "UNDERPERFORM")
LOGS = f"""lines AS (SELECT p_brand AS symbol, l_shipdate::DATE AS date, l_linestatus, l_discount, l_linenumber, ({", ".join(SEQ)}) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey),
    wl AS (SELECT symbol, date, arg_max(l_discount, seq) * 100 AS weight FROM lines WHERE l_linestatus = 'F' GROUP BY ALL),
    pl AS (SELECT symbol, date, arg_max([-1, 1, 1, 0, -1][l_linenumber % 5 + 1], seq)::DOUBLE AS label FROM lines WHERE l_linestatus = 'O' GROUP BY ALL)"""


def logs(spark, sf):
    rows = views.table(spark, sf, "lineitem").join(views.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol")), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("symbol", F.to_date("l_shipdate").alias("date"), F.struct(*SEQ).alias("seq"), "l_linestatus", (F.col("l_discount") * 100).alias("weight"), F.element_at(F.array(*map(F.lit, SAID)), F.col("l_linenumber") % 5 + 1).alias("label"))
    return rows, rows.where("l_linestatus = 'F'").drop("label"), rows.where("l_linestatus = 'O'").drop("weight")


SOME = ["return_1", "price_vs_sma50", "rsi_14", "technical_score", "volume_score"]


@query("features_as_of", f"""WITH RECURSIVE {FEATURES}, {NEWS}, week AS (SELECT p.symbol, p.date, coalesce(avg(s.score), 0)::DOUBLE AS news_sentiment, coalesce(count_if(label = 'POSITIVE'), 0)::DOUBLE AS news_positive
        FROM prices p LEFT JOIN scored s ON s.symbol = p.symbol AND s.published_at > p.date - 7 AND s.published_at <= p.date GROUP BY p.symbol, p.date), {LOGS},
    f AS (SELECT feat.*, news_sentiment, news_positive FROM feat JOIN week USING (symbol, date)), asked AS (SELECT DISTINCT symbol, last_day(date) AS date FROM lines)
    SELECT upper(a.symbol) AS symbol, a.date, f.date AS feature_date, {', '.join(f'round(f.{c}, 3)::DOUBLE AS {c}' for c in [*SOME, 'news_sentiment', 'news_positive'])}, coalesce(round(wl.weight, 3), 0)::DOUBLE AS portfolio_weight, coalesce(pl.label, 0)::DOUBLE AS last_label
    FROM asked a ASOF JOIN f ON a.symbol = f.symbol AND a.date >= f.date ASOF LEFT JOIN wl ON a.symbol = wl.symbol AND a.date >= wl.date ASOF LEFT JOIN pl ON a.symbol = pl.symbol AND a.date >= pl.date""", "prices", "news")
def features_as_of(spark, sf):
    """What was known of every symbol at the end of each month: features, weight held and last label said."""
    lines, weights, said = logs(spark, sf)
    asked = lines.select("symbol", F.last_day("date").alias("date")).distinct()
    out = learning.as_of(asked, learning.known_features(views.prices(spark, sf), _news(spark, sf)), weights, said)
    return out.select("symbol", "date", "feature_date", *[F.round(c, 3).alias(c) for c in [*SOME, "news_sentiment", "news_positive", "portfolio_weight"]], "last_label")


KINDS = ("LOGISTIC_REGRESSION", "RANDOM_FOREST", "HIST_GRADIENT_BOOSTING")


@query("model_registry", f"""WITH m AS (SELECT s_suppkey AS id, s_name AS name, {list(KINDS)}[s_nationkey % 3 + 1] AS model_type, DATE '2024-01-01' + (s_nationkey % 10)::INT AS trained_at, s_acctbal AS samples FROM supplier)
    SELECT id, name, model_type, trained_at, samples, row_number() OVER (ORDER BY trained_at DESC, id DESC) AS place FROM m""")
def model_registry(spark, sf):
    """Models and their training runs, published by type in one change each, one type twice: the list, the last trained first."""
    c, store = F.col("s_nationkey"), _store(spark)
    rows = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.element_at(F.array(*map(F.lit, KINDS)), c % 3 + 1).alias("model_type"), F.date_add(F.lit("2024-01-01").cast("date"), c % 10).alias("trained_at"), F.col("s_acctbal").alias("samples"))
    for kind in (*KINDS, KINDS[0]):
        own = rows.where(F.col("model_type") == kind)
        store.commit(put={registry.MODELS: {kind: own.drop("samples")}, registry.RUNS: {kind: own.select(F.col("id").alias("model_id"), "samples")}})
    runs = registry.training_runs(store).select(F.col("model_id").alias("id"), "samples")
    return registry.models(store).join(runs, "id").select("id", "name", "model_type", "trained_at", "samples", "place")


@query("recent_predictions", f"""WITH {LOGS}, p AS (SELECT upper(symbol) AS symbol, date, seq.l_orderkey AS k, seq.l_linenumber AS l, {list(SAID)}[l_linenumber % 5 + 1] AS label, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, seq DESC) AS place FROM lines)
    SELECT symbol, date, label, place::INT AS place FROM p WHERE place <= 10""".replace("(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount) AS seq", "{'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_discount': l_discount} AS seq"))
def recent_predictions(spark, sf):
    """The last ten predictions of every symbol, from a log written in batches, one of them twice."""
    rows, store = logs(spark, sf)[0].select("symbol", F.col("date").alias("created_at"), F.col("seq").alias("id"), "label", "l_linestatus"), _store(spark)
    for batch in ("F", "O", "O"):
        registry.add_predictions(store, batch, rows.where(F.col("l_linestatus") == batch))
    out = registry.recent_predictions(registry.predictions(store), 10)
    return out.select("symbol", F.col("created_at").alias("date"), "label", "place")


@query("ml_predictions")
def ml_predictions(spark, sf):
    """What a registered model says of every symbol as of its latest bar, with all features as known then: the weight held and what the model said a quarter before are among them."""
    store, bars = _store(spark), scratch.keep(views.prices(spark, sf), "bars")
    parts = scratch.keep(learning.split_by_time(data(spark, sf, bars=bars)), "parts")
    fitted = learning.train(parts.where("part = 'train'"))
    told = scratch.keep(learning.predict(fitted, parts.where("part = 'test'")).select("target", "probability"), "told")
    area = learning.auc(told)
    about = learning.measures(told).select(F.lit("next weeks").alias("name"), F.lit("LOGISTIC_REGRESSION").alias("model_type"), F.lit("POSITIVE_RETURN").alias("target_type"), F.lit(4).alias("horizon_days"), bars.agg(F.max("date")).scalar().alias("trained_at"), "f1", F.lit(area).cast("double").alias("auc"))
    registry.save(store, 1, about, parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), fitted)
    model, row = registry.load(store)
    known = scratch.keep(learning.known_features(bars, _news(spark, sf)), "known")
    latest = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    held = portfolio.value(views.positions(spark, sf), portfolio.latest(bars), views.assets(spark, sf), views.cash(spark, sf)).join(latest, "symbol").select("symbol", "date", F.lit(0).alias("seq"), "weight")
    nothing = spark.createDataFrame([], "symbol string, date date, seq int, label string")

    def say(asked, log):
        return learning.say(model, learning.as_of(asked, known, held, log), row.target_type, row.f1, row.auc)

    before = say(latest.withColumn("date", F.add_months("date", -3)), nothing)
    registry.add_predictions(store, "quarter", before.withColumns({"created_at": F.col("date"), "id": F.lit(1)}))
    log = registry.recent_predictions(registry.predictions(store), 1).select("symbol", "date", F.col("id").alias("seq"), "label")
    return say(latest, log)
