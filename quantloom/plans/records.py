"""Queries of what is written and read back: applied plans and imports, batches, runs with their children."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantloom.operators import portfolio, records
from quantloom.sources import scratch
from quantloom.sources.publish import Store

from . import views
from .catalog import LATEST, query
from .feeds import holdings_import


def _store(spark) -> Store:
    root = f"{scratch.root(spark)}/store-{uuid.uuid4().hex}"
    scratch.later(spark, root)
    return Store(spark, root)


@query("plan_applied", f"""WITH {LATEST}, p AS (SELECT symbol, close AS price, floor(20000::DOUBLE * (1 / (count(*) OVER ())::DOUBLE) / close) AS quantity FROM latest)
    SELECT symbol, quantity::DOUBLE AS quantity, price AS average_price, round(quantity * price, 4) AS invested_amount, asset_type, currency FROM p JOIN assets USING (symbol) WHERE quantity > 0""", "prices", "assets")
def plan_applied(spark, sf):
    """Positions after a plan of equal weights took the place of what was held."""
    store, assets = _store(spark), views.assets(spark, sf)
    records.replace_positions(store, views.positions(spark, sf).join(assets, "symbol"))
    latest = scratch.keep(portfolio.latest(views.prices(spark, sf)), "latest")
    equal = latest.select("symbol", (1 / latest.agg(F.count(F.lit(1))).scalar()).alias("equal"))
    records.apply_plan(store, portfolio.plan_quantities(equal, latest, "equal", 20_000.0), assets)
    return store.read("positions").withColumn("invested_amount", F.round("invested_amount", 4))


@query("import_applied", """SELECT upper('x' || p_partkey::VARCHAR) AS symbol, (p_size * 1000 + 125) / 100::DOUBLE AS quantity, p_retailprice AS average_price, round((p_size * 1000 + 125) / 100::DOUBLE * p_retailprice, 4) AS invested_amount,
    CASE WHEN p_partkey % 4 = 0 THEN 'etf' ELSE 'stock' END AS asset_type, CASE WHEN p_partkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, p_partkey % 2 <> 0 AS created FROM part WHERE p_partkey % 9 <> 0""")
def import_applied(spark, sf):
    """Positions after a sheet was imported, and which of their assets it added; those of even parts were known."""
    store, part = _store(spark), views.table(spark, sf, "part")
    known = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_name").alias("name"), F.lit("stock").alias("asset_type"), F.lit("USD").alias("currency"), F.lit("low").alias("risk_level"))
    store.commit(replace={"assets": known})
    records.apply_import(store, holdings_import(spark, sf).withColumn("name", F.col("symbol")))
    created = store.read("assets").where("risk_level = 'medium'").select("symbol", F.lit(True).alias("created"))
    rows = store.read("positions").join(created, "symbol", "left").withColumn("created", F.coalesce("created", F.lit(False)))
    return rows.withColumn("invested_amount", F.round("invested_amount", 4))


RUNS = ("A", "N", "R")


def _lines(spark, sf, *run_ids):
    """Order lines of the runs with their symbol, written once for all that is saved of them."""
    part = views.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    rows = views.table(spark, sf, "lineitem").where(F.col("l_returnflag").isin(*run_ids)).join(part, F.col("l_partkey") == F.col("p_partkey"))
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    return scratch.keep(rows.select("l_returnflag", F.to_date("l_shipdate").alias("date"), "symbol", "l_quantity", cents.alias("cents")), "lines", compression="zstd")


def _save(lines, store, run_id):
    own = lines.where(F.col("l_returnflag") == run_id)
    run = own.agg(F.count(F.lit(1)).alias("orders"))
    curve = own.groupBy("date").agg(F.sum("cents").alias("value"))
    trades = own.where("l_quantity >= 49").select("date", "symbol", F.col("l_quantity").alias("quantity"))
    positions = own.groupBy("symbol").agg(F.sum("l_quantity").alias("quantity"), F.sum("cents").alias("final_value"))
    records.save_run(store, run_id, run, curve, trades, positions)


@query("run_children", """WITH o AS (SELECT l_returnflag AS run_id, l_shipdate::DATE AS date, p_brand AS symbol, l_quantity, floor(l_extendedprice * 100 + .5::DOUBLE)::BIGINT AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N')
    SELECT run_id, count(*) AS orders, count(DISTINCT date) AS days, count(*) FILTER (WHERE l_quantity >= 49) AS trades, count(DISTINCT symbol) AS positions FROM o GROUP BY run_id""")
def run_children(spark, sf):
    """Runs and how many children each has, after one was saved twice and one deleted."""
    store, lines = _store(spark), _lines(spark, sf, *RUNS)
    for run_id in (*RUNS, "R"):
        _save(lines, store, run_id)
    records.delete_run(store, "N")
    out, held = store.read(records.CHILDREN[0]), store.manifest()
    for name, table in zip(("days", "trades", "positions"), records.CHILDREN[1:]):
        out = out.join(store.read(table, held).groupBy("run_id").agg(F.count(F.lit(1)).alias(name)), "run_id", "left")
    return out


@query("run_detail", """WITH o AS (SELECT l_shipdate::DATE AS date, p_brand AS symbol, l_quantity, floor(l_extendedprice * 100 + .5::DOUBLE)::BIGINT AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
    c AS (SELECT row_number() OVER (ORDER BY date) AS place, date, sum(v)::BIGINT AS value FROM o GROUP BY date), p AS (SELECT row_number() OVER (ORDER BY sum(v) DESC, symbol) AS place, symbol, sum(l_quantity) AS quantity FROM o GROUP BY symbol)
    SELECT 'curve' AS list, place::INT AS place, strftime(date, '%Y-%m-%d') AS name, value::DOUBLE AS value FROM c UNION ALL SELECT 'positions', place::INT, symbol, quantity::DOUBLE FROM p""")
def run_detail(spark, sf):
    """One run as a nested document, its lists taken apart again in their order."""
    store, lines = _store(spark), _lines(spark, sf, "A", "R")
    for run_id in ("A", "R"):
        _save(lines, store, run_id)
    one = records.run_detail(store, "R")
    curve = one.select(F.posexplode("curve").alias("k", "x")).select(F.lit("curve").alias("list"), (F.col("k") + 1).alias("place"), F.col("x.date").cast("string").alias("name"), F.col("x.value").cast("double").alias("value"))
    held = one.select(F.posexplode("positions").alias("k", "x")).select(F.lit("positions").alias("list"), (F.col("k") + 1).alias("place"), F.col("x.symbol").alias("name"), F.col("x.quantity").cast("double").alias("value"))
    return curve.unionByName(held)
