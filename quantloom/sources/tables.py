"""Merging new rows into tables, and writing tables as files. A table is rewritten whole or by partition; plain files have no row updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` (symbol, date, values, is_real, id) after taking ``new`` (symbol, date, values, seq) in, with action kept, updated or inserted.

    Of the old rows of a new row's symbol and date the first stays, updated (real ones first, then the lowest id), the
    others go; of several new rows of one key the last by seq counts. Rows without key are left out of ``new``."""
    values = [c for c in new.columns if c not in ("symbol", "date", "seq")]
    key = ["symbol", "date"]
    last = new.dropna(subset=key).groupBy(*key).agg(F.max_by(F.struct(*values), "seq").alias("x")).select(*key, "x.*")
    first = W.partitionBy(*key).orderBy(F.desc("is_real"), "id")
    had = old.withColumn("__k", F.row_number().over(first)).where("__k = 1").select(*key, "id", F.lit(True).alias("__there"))
    taken = last.join(had, key, "left").withColumns({"is_real": F.lit(True), "action": F.when(F.col("__there"), "updated").otherwise("inserted")}).drop("__there")
    kept = old.join(last.select(*key), key, "left_anti").withColumn("action", F.lit("kept"))
    return kept.unionByName(taken, allowMissingColumns=True)


def upsert_news(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` (id, symbol, url, title, published_at, ...) after taking ``new`` (the same and seq, without id) in, with action.

    A new item replaces the old one of its symbol and url, else the one of its symbol, title and time. Among new items
    the last of a url counts, and then the last of a title and time."""
    values = [c for c in new.columns if c != "seq"]
    own = ["symbol", "title", "__at"]
    late = lambda df, by: df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("seq")))).where("__k = 1").drop("__k")
    rows = new.withColumns({"__at": F.coalesce(F.col("published_at").cast("string"), F.lit("")), "__url": F.coalesce("url", F.concat(F.lit("\0"), F.col("seq").cast("string")))})
    rows = late(late(rows, ["symbol", "__url"]), own)
    at = old.withColumn("__at", F.coalesce(F.col("published_at").cast("string"), F.lit("")))
    by_url = old.where("url IS NOT NULL").groupBy("symbol", "url").agg(F.min("id").alias("__u"))
    by_title = at.groupBy(*own).agg(F.min("id").alias("__t"))
    met = rows.join(by_url, ["symbol", "url"], "left").join(by_title, own, "left").withColumn("id", F.coalesce("__u", "__t"))
    # Two new items may have met one old row, one by url and one by title: the last counts.
    met = met.withColumn("__row", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("new "), F.col("seq").cast("string"))))
    met = late(met, ["__row"]).withColumn("action", F.when(F.col("id").isNull(), "inserted").otherwise("updated"))
    kept = old.join(met.where("id IS NOT NULL").select("id"), "id", "left_anti").withColumn("action", F.lit("kept"))
    return kept.unionByName(met.select("id", *values, "action"), allowMissingColumns=True)


def insert_new(old: DataFrame, new: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` to append, and those refused since their key is there already or comes twice in ``new``."""
    place = new.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(*[c for c in new.columns if c not in key] or key)))
    there = old.select(*key).distinct().withColumn("__there", F.lit(True))
    told = place.join(there, list(key), "left").withColumn("__no", F.coalesce("__there", F.lit(False)) | (F.col("__k") > 1))
    return tuple(told.where(c).drop("__k", "__there", "__no") for c in ("NOT __no", "__no"))


def delete_cascade(keys: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the rows of the keys: a parent and its children alike."""
    gone = keys.select(key).distinct()
    return [t.join(gone, key, "left_anti") for t in tables]


def last_wins(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Settings, caches and the like: of old and new rows of a key the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rows = [c for c in both.columns if c not in (*key, "__new")]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rows), "__new").alias("x")).select(*key, "x.*")


def count_up(old: DataFrame, calls: DataFrame, *key: str, count: str = "calls_count") -> DataFrame:
    """Counters after some more calls (one row each)."""
    more = calls.groupBy(*key).agg(F.count(F.lit(1)).alias(count))
    return old.select(*key, count).unionByName(more).groupBy(*key).agg(F.sum(count).alias(count))


def backfill(rows: DataFrame, other: DataFrame, key: str, **columns: Column) -> DataFrame:
    """Missing values of the named columns from ``other``."""
    found = other.select(key, *[c.alias(f"__{n}") for n, c in columns.items()])
    out = rows.join(found, key, "left").withColumns({n: F.coalesce(n, f"__{n}") for n in columns})
    return out.drop(*[f"__{n}" for n in columns])


def layouts(tables: list[DataFrame], **fields: tuple[str, ...]) -> DataFrame:
    """Tables of several generations as one: each field is the first of its columns that has a value, in whichever table; columns that a table lacks are NULL.

    A column that no table has is an error."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    if missing := sorted({c for own in fields.values() for c in own} - set(rows.columns)):
        raise ValueError(f"no table has {', '.join(missing)}")
    return rows.select(*[F.coalesce(*[F.col(c) for c in own]).alias(name) for name, own in fields.items()])


def portfolio_export(valued: DataFrame) -> DataFrame:
    names = {"symbol": "symbol", "asset_type": "asset_type", "quantity": "quantity", "average_price": "average_price", "price": "current_price", "value": "current_value", "unrealized": "unrealized_pnl", "unrealized_percent": "unrealized_pnl_percent", "weight": "weight_percent", "currency": "currency"}
    return valued.select(*[(F.round(c, 2) if dict(valued.dtypes)[c] == "double" else F.col(c)).alias(n) for c, n in names.items()])


def orders_export(orders: DataFrame) -> DataFrame:
    gross = F.col("price") * F.col("quantity")
    net = gross + F.when(F.col("side") == "BUY", F.col("fees")).otherwise(-F.col("fees"))
    there = lambda c: F.coalesce(F.col(c), F.lit("")) if c in orders.columns else F.lit("")
    return orders.select(F.col("order_date").alias("date"), "symbol", F.col("side").alias("type"), "quantity", "price", "fees", F.round(gross, 2).alias("gross_amount"), F.round(net, 2).alias("net_amount"), there("note").alias("note"), there("strategy_tag").alias("strategy"))


def tax_export(events: DataFrame) -> DataFrame:
    return events.select("sell_date", "symbol", F.coalesce("asset_type", F.lit("")).alias("asset_type"), "category", "quantity", "proceeds", F.col("cost").alias("cost_basis"), "gain", F.col("rate").alias("rate_percent"), F.col("year").alias("tax_year"), "holding_days")


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV files with a header each, one a partition; ``one_file`` is for reports of a few rows."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def scan_prices(rows: DataFrame, symbols: list[str], until: str) -> DataFrame:
    """Rows of the named symbols, whatever their case and the space around them, up to and with a date."""
    return rows.where(F.upper("symbol").isin([x.strip().upper() for x in symbols]) & (F.col("date") <= F.lit(until).cast("date")))


def one_a_date(rows: DataFrame) -> DataFrame:
    """One row a symbol and date: of several the last with real ones first, then by id, so a seeded row goes before a real one; rows without date or close are left out after that."""
    others = [c for c in rows.columns if c not in ("symbol", "date")]
    last = rows.groupBy("symbol", "date").agg(F.max_by(F.struct(*others), F.struct(~F.col("is_real"), "id")).alias("x"))
    return last.select("symbol", "date", "x.*").dropna(subset=["date", "close"])


def refresh_summary(requested: DataFrame, merged: DataFrame) -> DataFrame:
    """One row on a refresh: symbols asked for, those that got rows and those that didn't, and rows inserted and updated."""
    got = merged.groupBy("symbol").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated")])
    rows = requested.join(got.withColumnsRenamed({"inserted": "__i", "updated": "__u"}), "symbol", "left").fillna(0, ["__i", "__u"])
    fresh = F.col("__i") + F.col("__u") > 0
    return rows.agg(F.count(F.lit(1)).alias("requested"), F.count_if(fresh).alias("updated"), F.count_if(~fresh).alias("fallback"), F.coalesce(F.sum("__i"), F.lit(0)).alias("rows_inserted"), F.coalesce(F.sum("__u"), F.lit(0)).alias("rows_updated"))


def cache_stats(entries: DataFrame, now: str) -> DataFrame:
    """Entries of a response cache, and how many are valid at ``now`` by their expires_at (text); those without a time, or one that can't be read, count as expired."""
    good = F.count_if(F.try_to_timestamp("expires_at") > F.lit(now).cast("timestamp"))
    return entries.agg(F.count(F.lit(1)).alias("entries"), good.alias("valid")).withColumn("expired", F.col("entries") - F.col("valid"))
