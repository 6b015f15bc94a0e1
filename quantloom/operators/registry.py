"""Models as published rows: a model with its training run, batches of predictions, and the lists that are read from them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.sources.publish import Store

from . import records

MODELS, RUNS, PREDICTIONS = "ml_models", "ml_training_runs", "ml_predictions"
#: How many predictions of a symbol a list may have.
LEAST, MOST = 1, 50


def save(store: Store, model_id: int, about: DataFrame, run: DataFrame, model: PipelineModel | None = None) -> int:
    """A model's row (name, model_type, target_type, horizon_days, trained_at and its measures) and its training run's, in one change.

    The fitted stages are written first, so a row is never without them; saved again, all three take their own place."""
    path = f"{store.root}/models/{model_id}-{max(store.versions(), default=0) + 1}" if model is not None else None
    if model is not None:
        model.write().overwrite().save(path)
    part, key = f"model-{model_id}", F.lit(model_id).cast("long")
    row = about.withColumns({"id": key, "model_path": F.lit(path).cast("string")})
    return store.commit(put={MODELS: {part: row}, RUNS: {part: run.withColumn("model_id", key)}})


def models(store: Store, manifest: dict | None = None) -> DataFrame:
    """Every model, with place 1 for the one trained last (of one moment the highest id)."""
    rows = store.read(MODELS, manifest)
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("trained_at"), F.desc("id"))).cast("long"))  # a row a model: a list for people


def model(store: Store, model_id: int | None = None) -> Row | None:
    """A model's row, the latest where none is named; None where there is none."""
    held = store.manifest()
    if MODELS not in held:
        return None
    rows = store.read(MODELS, held)
    return rows.where(F.col("id") == model_id).first() if model_id is not None else rows.orderBy(F.desc("trained_at"), F.desc("id")).first()


def load(store: Store, model_id: int | None = None) -> tuple[PipelineModel, Row]:
    """A model's fitted stages and its row."""
    row = model(store, model_id)
    if row is None:
        raise ValueError("there is no such model")
    if row.model_path is None:
        raise ValueError("the model has no fitted stages; train it again")
    return PipelineModel.load(row.model_path), row


def training_runs(store: Store) -> DataFrame:
    """Training runs with their model's name and type."""
    held = store.manifest()
    return store.read(RUNS, held).join(store.read(MODELS, held).select(F.col("id").alias("model_id"), "name", "model_type"), "model_id", "left")


def add_predictions(store: Store, batch: str, rows: DataFrame) -> int:
    """Predictions (symbol, created_at, id, ...) under a batch's name; the same batch again takes its own place."""
    return records.append(store, PREDICTIONS, batch, rows)


def predictions(store: Store) -> DataFrame:
    return store.read(PREDICTIONS)


def recent_predictions(rows: DataFrame, most: int = 10, symbol: str | None = None) -> DataFrame:
    """The latest predictions of every symbol, or of the named one, at most ``most`` (1 to 50) each."""
    rows = rows.withColumn("symbol", F.upper("symbol"))
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol.upper())
    late = W.partitionBy("symbol").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(late)).where(F.col("place") <= max(LEAST, min(MOST, most)))


def status(store: Store) -> Row:
    """How many models there are, the latest one's id, and how many predictions."""
    held = store.manifest()
    count = lambda t: store.read(t, held).count() if t in held else 0
    last = model(store)
    return Row(models=count(MODELS), latest=last.id if last else None, predictions=count(PREDICTIONS), ready=last is not None)
