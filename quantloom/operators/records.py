"""What a portfolio writes: positions replaced whole, plans and imports applied, runs with their children; each is one published change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.sources import scratch
from quantloom.sources.holdings import missing_assets
from quantloom.sources.publish import ALL, Store
from quantloom.sources.tables import last_wins

#: Settings of a new portfolio, in percent but for the first two.
SETTINGS = {
    "initial_cash": 100_000.0, "current_cash": 100_000.0, "max_single_asset_weight": 25.0, "max_asset_class_weight": 50.0, "default_fee_percent": 0.1,
    "crypto_max_weight": 15.0, "min_cash_weight": 2.0, "max_cash_weight": 35.0,
}
POSITION = "symbol string, quantity double, average_price double, invested_amount double, asset_type string, currency string"
CHILDREN = ("backtest_runs", "backtest_equity_curve", "backtest_trades", "backtest_positions")


def as_positions(items: DataFrame) -> DataFrame:
    """Positions of symbol, quantity, average_price, asset_type, currency."""
    amount = F.round(F.col("quantity") * F.col("average_price"), 6)
    return items.select("symbol", F.col("quantity").cast("double").alias("quantity"), "average_price", amount.alias("invested_amount"), "asset_type", F.coalesce("currency", F.lit("EUR")).alias("currency"))


def replace_positions(store: Store, items: DataFrame, **more: dict) -> int:
    """All positions become those of ``items``, which must be some; ``more`` is changed with them."""
    rows = as_positions(items)
    if rows.isEmpty():
        raise ValueError("no position to write")
    return store.commit(replace={"positions": rows}, **more)


def apply_plan(store: Store, plan: DataFrame, assets: DataFrame) -> int:
    """The planned quantities (symbol, quantity, price) become the positions; what has no quantity, price or asset is left out."""
    rows = plan.where("quantity > 0 AND price > 0").select(F.upper("symbol").alias("__s"), "quantity", F.col("price").alias("average_price"))
    rows = rows.join(assets.select("symbol", "asset_type", "currency"), F.col("__s") == F.upper("symbol"))
    return replace_positions(store, rows)


def apply_import(store: Store, held: DataFrame) -> dict[str, int]:
    """Assets that aren't known yet are added and the positions become those of the sheet (holdings()), in one change; how many were imported, created and refused."""
    held = scratch.keep(held, "held")  # a sheet, read several times
    good = held.where("error IS NULL")
    new = missing_assets(held, store.read("assets"))
    created = new.count()
    batch = f"import-{max(store.versions(), default=0) + 1}"
    replace_positions(store, good, put={"assets": {batch: new}} if created else {})
    return {"imported": good.count(), "created_assets": created, "rows_invalid": held.count() - good.count()}


def initialize(store: Store, snapshots: DataFrame, orders: DataFrame, **settings: float) -> int:
    """An empty portfolio: positions, orders and snapshots go, settings that are named change and the others stay as they were, or as in SETTINGS."""
    spark, old = store.spark, store.manifest()
    if unknown := sorted(set(settings) - set(SETTINGS)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    table = lambda values: spark.createDataFrame([(1, *map(float, values.values()))], f"id int, {', '.join(f'{c} double' for c in values)}")
    base = store.read("settings", old) if "settings" in old else table(SETTINGS)
    asked = {**base.drop("id").first().asDict(), **settings}
    asked["current_cash"] = settings.get("current_cash", asked["initial_cash"])
    wiped = {"positions": spark.createDataFrame([], POSITION), "orders": orders.limit(0), "snapshots": snapshots.limit(0)}
    return store.commit(replace={**wiped, "settings": last_wins(base, table(asked), "id")})


def append(store: Store, table: str, batch: str, rows: DataFrame) -> int:
    """Rows added under a batch's name; the same batch again takes its own place."""
    if batch == ALL:
        raise ValueError(f"{ALL} names whole tables")
    return store.commit(put={table: {batch: rows}})


def save_run(store: Store, run_id: str, run: DataFrame, curve: DataFrame, trades: DataFrame, positions: DataFrame) -> int:
    """A run and its children in one change; saved again it takes its own place."""
    return store.commit(put={t: {f"run-{run_id}": rows.withColumn("run_id", F.lit(run_id))} for t, rows in zip(CHILDREN, (run, curve, trades, positions))})


def delete_run(store: Store, run_id: str) -> int:
    """A run and its children go in one change."""
    return store.commit(drop={t: [f"run-{run_id}"] for t in CHILDREN})


def run_detail(store: Store, run_id: str) -> DataFrame:
    """A run's row with its curve (by date), trades (by date, symbol) and positions (by value, largest first) as arrays; one run's rows are read, no other's."""
    held, part = store.manifest(), [f"run-{run_id}"]
    out = store.read(CHILDREN[0], held, part)
    for name, table, order in (("curve", CHILDREN[1], ("date",)), ("trades", CHILDREN[2], ("date", "symbol")), ("positions", CHILDREN[3], ("-final_value", "symbol"))):
        rows = store.read(table, held, part)
        keys = [(-F.col(c[1:]) if c[0] == "-" else F.col(c)).alias(f"__k{k}") for k, c in enumerate(order)]
        listed = F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.struct(*[c for c in rows.columns if c != "run_id"]).alias("x")))), lambda y: y.x)
        out = out.join(rows.groupBy("run_id").agg(listed.alias(name)), "run_id", "left")
    return out
