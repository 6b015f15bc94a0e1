"""Data sets for models of future returns, splits by time, MLlib fits, their measures, and predictions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import text

from . import indicators, ranks, scan

PRICE_FEATURES = (
    "return_1 return_5 return_20 volatility_30 rsi_14 macd_line macd_histogram price_vs_sma50 price_vs_sma200 sma50_vs_sma200 atr_14 adx_14 percent_b max_drawdown_recent volume_ratio_20 "
    "technical_score trend_score momentum_score volatility_score volume_score support_resistance_score risk_penalty"
).split()
NEWS_FEATURES = ["news_sentiment", "news_positive", "news_negative", "news_high_impact"]
#: Both are 0 in training, as there was no portfolio at those dates.
OWN_FEATURES = ["portfolio_weight", "last_label"]
FEATURES = [*PRICE_FEATURES, *NEWS_FEATURES, *OWN_FEATURES]
TARGETS = ("POSITIVE_RETURN", "OUTPERFORM_BENCHMARK", "DRAWDOWN_RISK")


def trailing_news(bars: DataFrame, news: DataFrame, days: int = 7) -> DataFrame:
    """News of each bar's symbol in the ``days`` up to its date: sums of each day, then a range frame over days and bars together."""
    own = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    day = news.groupBy("symbol", F.col("published_at").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("t"), own(F.col("label") == "POSITIVE").alias("p"), own(F.col("label") == "NEGATIVE").alias("m"), own(F.col("impact") == "HIGH").alias("h")
    )
    rows = bars.select("symbol", "date", F.lit(True).alias("bar")).join(day, ["symbol", "date"], "full")
    span = W.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(1 - days, 0)
    total = lambda c: F.coalesce(F.sum(c).over(span), F.lit(0)).cast("double")
    rows = rows.select("symbol", "date", "bar", F.coalesce(F.try_divide(total("t"), total("n")), F.lit(0.0)).alias("news_sentiment"), total("p").alias("news_positive"), total("m").alias("news_negative"), total("h").alias("news_high_impact"))
    return rows.where("bar").drop("bar")


def universe(bars: DataFrame, assets: DataFrame, named: tuple[str, ...] = (), most: int = 120) -> DataFrame:
    """symbol, place: the symbols to train on, at most ``most``: the named ones in their order, each once, or all assets that have bars, by name."""
    if named:
        own = list(dict.fromkeys([x.strip().upper() for x in named if x.strip()][:most]))
        return bars.sparkSession.createDataFrame([(x, k + 1) for k, x in enumerate(own)], "symbol string, place int")
    rows = assets.join(bars, "symbol", "left_semi").select(F.upper("symbol").alias("symbol")).distinct().orderBy("symbol").limit(most)
    return rows.withColumn("place", F.row_number().over(W.orderBy("symbol")))


def dataset(bars: DataFrame, news: DataFrame, target: str = "POSITIVE_RETURN", horizon: int = 4, benchmark: str | None = None) -> DataFrame:
    """symbol, date, target_date, target and FEATURES of every bar that has them all."""
    if target not in TARGETS:
        raise ValueError(f"unknown target {target}")
    ahead = indicators.targets(bars, horizon).select("symbol", "date", "target_date", "future_return", "positive_return", "drawdown_risk").dropna(subset=["target_date", "future_return"])
    rows = indicators.features(bars).select("symbol", "date", *PRICE_FEATURES).join(trailing_news(bars, news), ["symbol", "date"]).join(ahead, ["symbol", "date"])
    if target == "OUTPERFORM_BENCHMARK":
        rows = rows.join(ahead.where(F.col("symbol") == benchmark).select("date", F.col("future_return").alias("__b")), "date").withColumn("target", (F.col("future_return") > F.col("__b")).cast("int")).drop("__b")
    else:
        rows = rows.withColumn("target", F.col("positive_return" if target == "POSITIVE_RETURN" else "drawdown_risk"))
    rows = rows.withColumns({c: F.lit(0.0) for c in OWN_FEATURES}).dropna(subset=["target", *FEATURES])
    return rows.select("symbol", "date", "target_date", "target", *FEATURES)


def looks_ahead(rows: DataFrame) -> DataFrame:
    """Rows whose target isn't after their features; there must be none."""
    return rows.where(F.col("target_date") <= F.col("date"))


def _dates(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Each date with its place from 0, and how many there are; one row a trading day."""
    days = rows.select("date").distinct()
    return days.withColumn("__place", F.row_number().over(W.orderBy("date")) - 1), days.agg(F.count(F.lit(1))).scalar()


def split_by_time(rows: DataFrame, test_percent: float = 25) -> DataFrame:
    """``rows`` with ``part`` train or test: the last dates are for the test, both sides have one date at least."""
    days, n = _dates(rows)
    cut = F.least(F.greatest(F.floor(n * (1 - test_percent / 100)), F.lit(1)), n - 1)
    return rows.join(days, "date").withColumn("part", F.when(F.col("__place") < cut, "train").otherwise("test")).drop("__place")


def expanding_folds(rows: DataFrame, folds: int = 4) -> DataFrame:
    """Each row once for every fold that it is in: fold k trains on all dates before its test slice. None with fewer than 2 (folds + 1) dates."""
    days, n = _dates(rows)
    step = F.floor(n / (folds + 1))
    out = rows.join(days, "date").where(n >= 2 * (folds + 1)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    end = F.when(F.col("fold") < folds, step * (F.col("fold") + 1)).otherwise(n)
    part = F.when(F.col("__place") < step * F.col("fold"), "train").when(F.col("__place") < end, "test")
    return out.withColumn("part", part).where("part IS NOT NULL").drop("__place")


def balanced(rows: DataFrame) -> DataFrame:
    """``rows`` with ``weight``: both targets weigh alike."""
    n = rows.groupBy("target").agg(F.count(F.lit(1)).alias("__n"))
    total, kinds = n.agg(F.sum("__n")).scalar(), n.agg(F.count(F.lit(1))).scalar()
    return rows.join(n, "target").withColumn("weight", total / (kinds * F.col("__n"))).drop("__n")


def pipeline(kind: str, rows: int, seed: int = 42, trees: int = 200, rounds: int = 300) -> Pipeline:
    """Untrained stages: medians for what is missing, then a logistic regression on scaled features, a forest or boosted trees."""
    filled = [f"{c}__" for c in FEATURES]
    stages = [Imputer(strategy="median", inputCols=FEATURES, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="vector")]
    own = {"labelCol": "target", "weightCol": "weight"}
    if kind == "LOGISTIC_REGRESSION":
        stages += [StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", maxIter=1000, regParam=1 / max(rows, 1), standardization=False, **own)]
    elif kind == "RANDOM_FOREST":
        stages.append(RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=8, minInstancesPerNode=4, seed=seed, **own))
    elif kind == "GRADIENT_BOOSTING":
        stages.append(GBTClassifier(featuresCol="vector", maxIter=rounds, maxDepth=4, stepSize=0.06, seed=seed, **own))
    else:
        raise ValueError(f"unknown model {kind}")
    return Pipeline(stages=stages)


def train(rows: DataFrame, kind: str = "LOGISTIC_REGRESSION", **options) -> PipelineModel:
    """A model of ``rows`` (target, FEATURES); an error where they have one kind of target only."""
    counts = {r.target: r.n for r in rows.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        raise ValueError("the training rows have one kind of target only")
    return pipeline(kind, sum(counts.values()), **options).fit(balanced(rows))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``probability`` of target 1; missing features count as 0."""
    keep = [c for c in rows.columns if c not in FEATURES]
    ready = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in FEATURES})
    return model.transform(ready).withColumn("__p", vector_to_array("probability")[1]).select(*keep, F.col("__p").alias("probability"))


def measures(predicted: DataFrame, *by: str) -> DataFrame:
    """accuracy, precision, recall, f1 and the confusion counts of predictions at 0.5, of all rows or of each ``by``; 0 where a ratio has no divisor."""
    hit, yes = F.col("target") == 1, F.col("probability") >= 0.5
    counts = F.count_if(hit & yes).alias("tp"), F.count_if(~hit & yes).alias("fp"), F.count_if(hit & ~yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn")
    out = predicted.groupBy(*by).agg(*counts)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    out = out.withColumns({"accuracy": ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn"))})
    return out.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def auc(predicted: DataFrame) -> float | None:
    """Area under the ROC curve; None where there is one kind of target only."""
    found = ranks.areas(predicted.select(F.lit("all").alias("of"), "target", "probability"), "of").first()
    return found.area if found else None


def cross_validate(rows: DataFrame, kind: str, folds: int = 4, **options) -> dict[str, float | int | None] | None:
    """Means (and the population deviation of the accuracy) over folds that expand in time; folds of one kind of target are skipped."""
    found, parts = [], expanding_folds(rows, folds).cache()
    for k in range(1, folds + 1):  # a model a fold
        own = parts.where(F.col("fold") == k)
        if own.where("part = 'train'").select("target").distinct().count() < 2 or own.where("part = 'test'").isEmpty():
            continue
        told = predict(train(own.where("part = 'train'"), kind, **options), own.where("part = 'test'"))
        found.append((measures(told).first(), auc(told)))
    parts.unpersist()
    if not found:
        return None
    mean = lambda x: sum(x) / len(x)
    acc, areas = [m.accuracy for m, _ in found], [a for _, a in found if a is not None]
    return {"folds": len(found), "accuracy_mean": mean(acc), "accuracy_std": mean([(a - mean(acc)) ** 2 for a in acc]) ** 0.5, "f1_mean": mean([m.f1 for m, _ in found]), "auc_mean": mean(areas) if areas else None}


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Features by what they weigh: coefficients with their sign, or impurity importances."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return sorted(zip(FEATURES, map(float, values.toArray())), key=lambda x: -abs(x[1]))


def permutation_importances(model: PipelineModel, rows: DataFrame, features: list[str] | None = None, repeats: int = 5, seed: int = 42) -> list[tuple[str, float]]:
    """How much the area under the curve falls when a feature's values are dealt anew among the rows, the largest fall first.

    A repeat deals each row another one by global places; a copy of each row a feature takes that feature from the other
    row, and all copies are scored and ranked in one pass."""
    features = features or FEATURES
    own = ranks.numbered(rows.select("symbol", "date", "target", *FEATURES), "at", "date", "symbol")
    whole = auc(predict(model, own)) or 0.0
    lost = dict.fromkeys(features, 0.0)
    for k in range(repeats):
        order = own.select("at", F.xxhash64(F.lit(seed + k), "at").alias("by"), F.struct(*features).alias("other"))
        dealt = ranks.numbered(order, "to", "by", "at").select(F.col("to").alias("at"), "other")
        copies = own.join(dealt, "at").withColumn("of", F.explode(F.array(*map(F.lit, features))))
        copies = copies.select("of", "target", *[F.when(F.col("of") == c, F.col(f"other.{c}")).otherwise(F.col(c)).alias(c) if c in features else F.col(c) for c in FEATURES])
        for r in ranks.areas(predict(model, copies), "of").collect():  # a row a feature
            lost[r.of] += whole - (r.area or 0.0)
    return sorted(((f, x / repeats) for f, x in lost.items()), key=lambda x: -x[1])


def known_features(bars: DataFrame, news: DataFrame) -> DataFrame:
    """symbol, date and the features of prices and news of every bar, complete or not."""
    return indicators.features(bars).select("symbol", "date", *PRICE_FEATURES).join(trailing_news(bars, news), ["symbol", "date"])


def as_of(asked: DataFrame, features: DataFrame, weights: DataFrame, predictions: DataFrame) -> DataFrame:
    """symbol, date, feature_date, FEATURES and said of each asked (symbol, date), each as known on that date; symbols without regard to case.

    Features are those of the latest bar up to the date, a portfolio's weight is that of the latest row of ``weights``
    (symbol, date, seq, weight), the last label that of ``predictions`` (symbol, date, seq, label); of rows of one symbol
    and date the last by seq counts, and said (date, label) is that row of ``predictions``. Without a weight or label they
    are 0 and said is NULL; without a bar there is no row. The logs are first one row a symbol and date, then one union in
    order of dates, over which the last known values are carried."""
    upper = F.upper("symbol").alias("symbol")
    last = lambda log, value: log.groupBy(upper, "date").agg(F.max_by(value, "seq").alias("x"))
    told = features.select(upper, "date", F.struct(F.col("date").alias("feature_date"), *PRICE_FEATURES, *NEWS_FEATURES).alias("bar"), F.lit(0).alias("kind"))
    held = last(weights, F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).select("symbol", "date", F.col("x").alias("portfolio_weight"), F.lit(0).alias("kind"))
    said = last(predictions, F.struct("date", "label")).select("symbol", "date", F.col("x").alias("said"), F.lit(0).alias("kind"))
    rows = told.unionByName(held, True).unionByName(said, True).unionByName(asked.select(upper, "date", F.lit(1).alias("kind")), True)
    rows = scan.carried(rows, "symbol", ["bar", "portfolio_weight", "said"], "date", "kind").where("kind = 1 AND bar IS NOT NULL")
    rows = rows.withColumn("last_label", text.encode_label(F.col("said.label")).cast("double"))
    return rows.select("symbol", "date", "bar.*", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in OWN_FEATURES], "said")


LABELS = {"POSITIVE_RETURN": ("POSITIVE_RETURN", "NON_POSITIVE_RETURN"), "OUTPERFORM_BENCHMARK": ("OUTPERFORM", "UNDERPERFORM"), "DRAWDOWN_RISK": ("DRAWDOWN_RISK", "LOW_DRAWDOWN_RISK")}


def judge(predicted: DataFrame, target: str, f1: float, area: float | None) -> DataFrame:
    """Predictions with label, confidence (from the probability and the model's measures) and warnings."""
    p = F.col("probability")
    strength, yes, no = F.greatest(p, 1 - p), *LABELS[target]
    high = (strength >= 0.70) & F.lit(f1 >= 0.55 and (area is None or area >= 0.55))
    sure = F.when(high, "HIGH").when((strength >= 0.58) & F.lit(f1 >= 0.45), "MEDIUM").otherwise("LOW")
    out = predicted.withColumns({"label": F.when(p >= 0.5, yes).otherwise(no), "confidence": sure})
    said = F.array_compact(F.array(F.when(F.lit(f1 < 0.45), "WEAK_MODEL"), F.when(F.lit(area is not None and area < 0.52), "NEAR_CHANCE"), F.when(F.col("confidence") == "LOW", "UNDECIDED")))
    return out.withColumn("warnings", F.array_join(said, ","))


def say(model: PipelineModel, ready: DataFrame, target: str, f1: float, area: float | None) -> DataFrame:
    """What a model says of rows of as_of(): symbol, date, probability, judge()'s columns, and beside them what was known then: feature_date, features (all of FEATURES; NULL for what is missing) and said, the prediction before.

    A model of dataset() gives OWN_FEATURES no weight, as both are 0 in its rows; a prediction keeps them all the same."""
    kept = predict(model, ready.withColumn("features", F.struct(*FEATURES)))
    return judge(kept, target, f1, area).select("symbol", "date", "probability", "label", "confidence", "warnings", "feature_date", "features", "said")
