"""Valuation, risk, allocation, scenarios, rebalancing and FIFO tax lots over positions and order logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.dates import holding_days
from quantloom.functions.numeric import divide, flag
from quantloom.sources import scratch

from . import scan

#: Class shocks in percent of the six scenarios.
SCENARIOS = {
    "MARKET_CRASH": {"stock": -25.0, "etf": -22.0, "crypto": -45.0, "bond": -3.0, "bond_etf": -5.0},
    "TECH_SELLOFF": {"stock": -18.0, "etf": -12.0, "crypto": -25.0, "bond": 1.0, "bond_etf": 0.0},
    "CRYPTO_WINTER": {"stock": -3.0, "etf": -2.0, "crypto": -55.0, "bond": 0.0, "bond_etf": 0.0},
    "RATE_HIKE": {"stock": -8.0, "etf": -7.0, "crypto": -15.0, "bond": -12.0, "bond_etf": -10.0},
    "INFLATION_SHOCK": {"stock": -10.0, "etf": -9.0, "crypto": -20.0, "bond": -8.0, "bond_etf": -7.0},
    "MILD_CORRECTION": {"stock": -7.0, "etf": -6.0, "crypto": -12.0, "bond": -1.0, "bond_etf": -2.0},
}


def latest(bars: DataFrame) -> DataFrame:
    """Latest close of each symbol, the one before, change in percent."""
    late = W.partitionBy("symbol").orderBy("date")
    rows = bars.select("symbol", "date", "close", F.lag("close").over(late).alias("previous_close"))
    top = rows.groupBy("symbol").agg(F.max_by(F.struct("date", "close", "previous_close"), "date").alias("x")).select("symbol", "x.*")
    return top.withColumn("change_percent", (divide(F.col("close"), F.col("previous_close")) - 1) * 100)


#: Limits in percent of the whole portfolio.
LIMITS = {"asset": 25.0, "class": 50.0, "crypto": 15.0, "least_cash": 2.0, "most_cash": 35.0, "weak": 12.0, "three": 70.0}


def value(positions: DataFrame, prices: DataFrame, assets: DataFrame, cash: float | Column = 0.0) -> DataFrame:
    """Positions at latest prices with unrealised result and weight in all that is held, ``cash`` included; NULL values where no price is known."""
    out = positions.join(prices.select("symbol", F.col("close").alias("price")), "symbol", "left").join(assets.select("symbol", "asset_type", "currency", "risk_level"), "symbol", "left")
    out = scratch.keep(out.withColumn("value", F.col("quantity") * F.col("price")), "valued")  # a row a position, used twice
    total = out.agg(F.sum("value")).scalar() + (F.lit(cash) if isinstance(cash, float) else cash)  # one number, not a window over all rows
    out = out.withColumns({"unrealized": F.col("value") - F.col("invested_amount"), "weight": divide(F.col("value") * 100, total)})
    return out.withColumns({"unrealized_percent": divide(F.col("unrealized") * 100, F.col("invested_amount")), "class_weight": F.sum("weight").over(W.partitionBy("asset_type"))})


def summary(valued: DataFrame, cash: Column, initial: Column) -> DataFrame:
    """One row: cash, invested and total value, unrealised result and its percentage of the initial cash, weights of classes and currencies as maps."""
    shares = lambda by: F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "share"))))
    total = valued.agg(F.coalesce(F.sum("value"), F.lit(0.0))).scalar() + cash
    parts = [valued.groupBy(c).agg(F.round(F.sum("value") * 100 / F.first(total), 2).alias("share")).agg(shares(c)).scalar().alias(n) for c, n in (("asset_type", "by_class"), ("currency", "by_currency"))]
    row = valued.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("invested"), F.coalesce(F.sum("unrealized"), F.lit(0.0)).alias("unrealized"), F.count(F.lit(1)).alias("positions"))
    row = row.withColumns({"cash": cash, "total": F.col("invested") + cash, "unrealized_percent": F.coalesce(divide(F.col("unrealized") * 100, initial), F.lit(0.0))})
    return row.select("*", *parts)


def recommend(valued: DataFrame, signals: DataFrame, assets: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """What to do about every asset, held or not: signals (symbol, signal, score) within the limits of weights."""
    classes = valued.groupBy("asset_type").agg(F.sum("weight").alias("class_weight"))
    rows = assets.select("symbol", "asset_type", "risk_level").join(valued.select("symbol", "weight", "value"), "symbol", "left").join(classes, "asset_type", "left").join(signals.select("symbol", "signal", "score"), "symbol", "left")
    rows = rows.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "class_weight": F.coalesce("class_weight", F.lit(0.0)), "__buy": flag(F.col("signal").isin("BUY", "STRONG_BUY"))})
    c = F.col
    out = (
        F.when((c("weight") >= limits["asset"]) | (c("class_weight") >= limits["class"]), "BLOCK_BUY_TOO_CONCENTRATED")
        .when((c("asset_type") == "crypto") & (c("class_weight") >= limits["crypto"]), "BLOCK_BUY_HIGH_RISK").when(F.lower("risk_level").isin("high", "very_high") & ~c("__buy"), "BLOCK_BUY_HIGH_RISK")
        .when(c("signal").isin("SELL", "REDUCE"), c("signal")).when(c("__buy") & (c("weight") < 0.8 * limits["asset"]), "BUY_ALLOWED").otherwise("HOLD")
    )
    return rows.withColumn("recommendation", out).drop("__buy")


def warnings(valued: DataFrame, signals: DataFrame, cash: Column, limits: dict[str, float] = LIMITS) -> DataFrame:
    """level, code, subject, value of every broken limit; none where nothing is held and there is no cash."""
    say = lambda cond, level, code, subject, v: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), v.cast("double").alias("value")))
    each = lambda df, *said: df.select(F.inline(F.array_compact(F.array(*said))))
    c, none = F.col, F.lit(None)
    rows = valued.join(signals.select("symbol", "signal"), "symbol", "left")
    kind = valued.groupBy("asset_type").agg(F.sum("weight").alias("w"))
    three = valued.orderBy(F.desc_nulls_last("weight"), "symbol").limit(3).agg(F.sum("weight").alias("three"))
    whole = valued.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("held")).crossJoin(three).withColumn("share", F.when(c("held") + cash > 0, cash * 100 / (c("held") + cash)))  # one row each
    return (
        each(rows, say(c("weight") > limits["asset"], "WARNING", "SINGLE_ASSET_CONCENTRATION", c("symbol"), c("weight")), say((c("weight") > limits["weak"]) & c("signal").isin("SELL", "REDUCE"), "WARNING", "WEAK_SIGNAL_OVERWEIGHT", c("symbol"), c("weight")))
        .unionByName(each(kind, say(c("w") > limits["class"], "WARNING", "ASSET_CLASS_CONCENTRATION", c("asset_type"), c("w")), say((c("asset_type") == "crypto") & (c("w") > limits["crypto"]), "WARNING", "CRYPTO_OVERWEIGHT", none, c("w"))))
        .unionByName(each(whole, say(c("share") > limits["most_cash"], "INFO", "HIGH_CASH", none, c("share")), say(c("share") < limits["least_cash"], "WARNING", "LOW_CASH", none, c("share")), say(c("three") > limits["three"], "WARNING", "TOP_THREE_CONCENTRATION", none, c("three"))))
    )


#: How many assets to buy the board shows.
BUYS = 6


def board(recommended: DataFrame, warned: DataFrame) -> DataFrame:
    """What to do today: place, kind, priority, symbol, code, score, weight; one OK row if there is nothing."""
    c, held, none = F.col, F.col("weight") > 0, F.lit(None)
    rows = recommended.withColumn("kind", (
        F.when(held & (flag(c("signal") == "SELL") | (c("recommendation") == "SELL")), "SELL").when(held & (flag(c("signal") == "REDUCE") | (c("recommendation") == "REDUCE")), "REDUCE")
        .when(~held & (c("recommendation") == "BUY_ALLOWED"), "BUY")
    )).where("kind IS NOT NULL")
    strong = flag((c("signal") == "STRONG_BUY") | (c("score") >= 75))
    rows = rows.select("kind", F.when((c("kind") == "SELL") | ((c("kind") == "BUY") & strong), "HIGH").otherwise("MEDIUM").alias("priority"), "symbol", c("recommendation").alias("code"), "score", "weight")
    buys = rows.where("kind = 'BUY'").orderBy(F.desc_nulls_last("score"), "symbol").limit(BUYS)
    risks = warned.select(F.lit("RISK").alias("kind"), F.when(c("level") == "WARNING", "HIGH").otherwise("LOW").alias("priority"), c("subject").alias("symbol"), "code", none.cast("double").alias("score"), none.cast("double").alias("weight"))
    found = rows.where("kind != 'BUY'").unionByName(buys).unionByName(risks)
    quiet = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("OK").alias("kind"), F.lit("LOW").alias("priority"), none.cast("string").alias("symbol"), F.lit("NOTHING_URGENT").alias("code"), none.cast("double").alias("score"), none.cast("double").alias("weight"))
    rank = F.when(c("priority") == "HIGH", 0).when(c("priority") == "MEDIUM", 1).otherwise(2)
    return found.unionByName(quiet).withColumn("rank", rank)


def headline(acted: DataFrame) -> DataFrame:
    """How many of each kind the board has."""
    return acted.agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("BUY", "REDUCE", "SELL", "RISK")])


def allocate(bars: DataFrame, signals: DataFrame, lookback: int = 120, target: float = 0.15, most: float | None = None) -> DataFrame:
    """Weights by four methods: equal, risk parity, score, and inverse volatility scaled to a target; all but the last capped at ``most`` first.

    A cap that can't be met (most times assets below 1) or of 1 or more is ignored. What is cut goes to the others by the room that they have left."""
    late = W.partitionBy("symbol").orderBy(F.desc("date"))
    rows = bars.where("close IS NOT NULL").withColumn("__k", F.row_number().over(late)).where(F.col("__k") <= lookback)
    rows = rows.withColumn("__r", divide(F.col("close"), F.lag("close").over(W.partitionBy("symbol").orderBy("date"))) - 1)
    vol = rows.groupBy("symbol").agg(F.coalesce(F.when(F.count("__r") >= 2, F.stddev_samp("__r") * (252**0.5)), F.lit(0.0)).alias("volatility"))
    out = scratch.keep(vol.join(signals.select("symbol", "score"), "symbol").withColumns({"__inv": F.when(F.col("volatility") > 1e-6, 1 / F.col("volatility")).otherwise(0.0), "__above": F.greatest(F.coalesce("score", F.lit(0.0)) - 50, F.lit(0.0))}), "allocated")  # a row an asset, used for its sums too
    sums = out.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("__inv").alias("inv"), F.sum("__above").alias("above"))).scalar()
    equal = 1 / sums["n"]
    out = out.withColumns({"equal": equal, "risk_parity": F.coalesce(divide(F.col("__inv"), sums["inv"]), equal), "score_weighted": F.coalesce(divide(F.col("__above"), sums["above"]), equal)})
    names = ["equal", "risk_parity", "score_weighted"]
    if most is not None and 0 < most < 1:
        room = out.agg(F.struct(F.count(F.lit(1)).alias("n"), *[F.struct(F.sum(F.greatest(F.col(n) - most, F.lit(0.0))).alias("excess"), F.sum(F.greatest(most - F.col(n), F.lit(0.0))).alias("room")).alias(n) for n in names])).scalar()
        share = lambda n: F.least(F.col(n), F.lit(most)) + F.coalesce(divide(room[n]["excess"], room[n]["room"]), F.lit(0.0)) * F.greatest(most - F.col(n), F.lit(0.0))
        out = out.withColumns({n: F.when(most * room["n"] < 1 - 1e-9, F.col(n)).otherwise(share(n)) for n in names})
    risk = out.agg(F.sum(F.col("risk_parity") * F.col("volatility"))).scalar()
    return out.withColumn("vol_target", F.col("risk_parity") * F.least(F.lit(1.0), F.coalesce(divide(F.lit(target), risk), F.lit(1.0)))).drop("__inv", "__above")


def plan_quantities(allocated: DataFrame, prices: DataFrame, weight: str, capital: float) -> DataFrame:
    """Capital and whole quantity of each symbol at its latest price; 0 where none is known."""
    out = allocated.join(prices.select("symbol", F.col("close").alias("price")), "symbol", "left").withColumn("capital", F.col(weight) * capital)
    return out.withColumn("quantity", F.coalesce(F.floor(divide(F.col("capital"), F.when(F.col("price") > 0, F.col("price")))), F.lit(0)).cast("long"))


def stress(valued: DataFrame, shocks: dict[str, float]) -> DataFrame:
    """Value of each asset class before and after its shock (percent)."""
    shock = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shocks.items() for x in kv]), F.col("asset_type")), F.lit(0.0))
    out = valued.groupBy("asset_type").agg(F.sum("value").alias("value"), F.sum(F.greatest(F.col("value") * (1 + shock / 100), F.lit(0.0))).alias("stressed"))
    return out.withColumn("impact", F.col("stressed") - F.col("value"))


def impacts(valued: DataFrame, presets: dict[str, dict[str, float]] = SCENARIOS, symbol_shocks: dict[str, float] | None = None) -> DataFrame:
    """scenario, symbol, kind, value, shock, stressed, impact, contribution (percent of the scenario's loss) of every position; a symbol's own shock goes before its class's.

    Positions without a class count as stock, classes without a shock stay as they are."""
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]).cast("map<string,double>") if m else F.lit(None).cast("map<string,double>")
    shocks = F.array(*[F.struct(F.lit(n).alias("scenario"), table({k.lower(): float(v) for k, v in m.items()}).alias("shocks")) for n, m in presets.items()])
    own = F.try_element_at(table({k.upper(): float(v) for k, v in (symbol_shocks or {}).items()}), F.upper("symbol"))
    rows = valued.select("symbol", F.lower(F.coalesce("asset_type", F.lit("stock"))).alias("kind"), "value", F.inline(shocks))
    rows = rows.withColumn("shock", F.coalesce(own, F.try_element_at("shocks", F.col("kind")), F.lit(0.0))).drop("shocks")
    rows = rows.withColumn("impact", F.col("value") * F.col("shock") / 100).withColumn("stressed", F.greatest(F.col("value") + F.col("impact"), F.lit(0.0)))
    loss = rows.groupBy("scenario").agg(F.sum("impact").alias("__loss"))
    return rows.join(loss, "scenario").withColumn("contribution", F.when(F.col("__loss") < 0, F.col("impact") * 100 / F.col("__loss")).otherwise(0.0)).drop("__loss")


def class_impacts(hit: DataFrame) -> DataFrame:
    out = hit.groupBy("scenario", "kind").agg(F.sum("value").alias("value"), F.sum("stressed").alias("stressed")).withColumn("impact", F.col("stressed") - F.col("value"))
    return out.withColumn("shock", F.when(F.col("value") > 0, F.col("impact") * 100 / F.col("value")).otherwise(0.0))


def scenarios(valued: DataFrame, cash: float | Column = 0.0, presets: dict[str, dict[str, float]] = SCENARIOS, symbol_shocks: dict[str, float] | None = None) -> DataFrame:
    """Each scenario's value of the portfolio before and after, its loss in percent, risk level and tips (codes)."""
    if "symbol" not in valued.columns:
        valued = valued.withColumn("symbol", F.lit(None).cast("string"))
    cash = F.lit(cash) if isinstance(cash, (int, float)) else cash
    hit = impacts(valued, presets, symbol_shocks)
    kinds = class_impacts(hit)
    worst = kinds.groupBy("scenario").agg(F.min_by(F.struct("kind", "impact"), F.struct("impact", "kind")).alias("__worst"), F.coalesce(F.sum(F.when(F.col("kind") == "crypto", F.col("value"))), F.lit(0.0)).alias("__crypto"))
    out = hit.groupBy("scenario").agg((F.coalesce(F.sum("value"), F.lit(0.0)) + cash).alias("value"), (F.coalesce(F.sum(F.floor(F.col("stressed") * 100 + 0.5) / 100), F.lit(0.0)) + cash).alias("stressed")).join(worst, "scenario")
    out = out.withColumn("loss", F.round(F.col("stressed") - F.col("value"), 2))
    out = out.withColumn("loss_percent", F.coalesce(F.when(F.col("value") > 0, F.round(divide(F.col("loss") * 100, F.col("value")), 2)), F.lit(0.0)))
    out = out.withColumn("risk_level", F.when(F.col("loss_percent") <= -25, "EXTREME").when(F.col("loss_percent") <= -15, "HIGH").when(F.col("loss_percent") <= -5, "MEDIUM").otherwise("LOW"))
    tips = F.array_compact(F.array(
        F.when(F.col("risk_level").isin("HIGH", "EXTREME"), "REDUCE_RISK"), F.when(F.coalesce(divide(F.col("__crypto"), F.col("value")), F.lit(0.0)) > 0.15, "TRIM_CRYPTO"),
        F.when(F.coalesce(F.when(F.col("value") > 0, cash * 100 / F.col("value")), F.lit(0.0)) < 5, "RAISE_CASH"), F.when(F.col("__worst.impact") < 0, F.concat(F.lit("DIVERSIFY:"), F.col("__worst.kind"))),
    ))
    return out.withColumn("tips", F.array_join(F.when(F.size(tips) > 0, tips).otherwise(F.array(F.lit("NONE_URGENT"))), ",")).drop("__worst", "__crypto")


def rebalance(valued: DataFrame, target: DataFrame, weight: str, capital: float) -> DataFrame:
    """From held to target values: action (HOLD within one unit of currency), delta, quantity; latest prices of both sides."""
    rows = valued.select("symbol", "value", "price").join(target.select("symbol", F.col(weight).alias("w"), *(["close"] if "close" in target.columns else [])), "symbol", "full")
    price = F.coalesce("close", "price") if "close" in target.columns else F.col("price")
    rows = rows.withColumn("delta", F.coalesce(F.col("w") * capital, F.lit(0.0)) - F.coalesce("value", F.lit(0.0)))
    action = F.when(F.col("delta") > 1, "BUY").when(F.col("delta") < -1, "SELL").otherwise("HOLD")
    return rows.select("symbol", action.alias("side"), "delta", divide(F.abs("delta"), price).alias("quantity"))


def micro(x: Column) -> Column:
    """Money in whole millionths, whose sums don't depend on their order."""
    return F.floor(x * 1e6 + 0.5).cast("long")


def cents_of(micros: Column) -> Column:
    return F.floor(micros / 10_000 + 0.5) / 100


#: Parts of a unit of quantity that are told apart: an order of less counts as none. A symbol's volume stays below 9.2e9 units; arithmetic beyond that raises an error.
PARTS = 10**9


def parts_of(quantity: Column) -> Column:
    """Whole billionths, whose sums meet where the quantities do."""
    return F.floor(quantity * PARTS + 0.5).cast("long")


def lots(orders: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """Every buy and matched sell as an interval of cumulative quantity in whole billionths: symbol, side, start, end, unit (price with fees), order_date, seq, matched (the symbol's sold quantity).

    What is sold beyond the holding is dropped: the holding after each order is its running sum less that sum's least value
    below 0. With ``bounds`` (scan.bounds) one symbol fills many tasks: a chunk of its orders hands on its sum and least sum,
    which compose, and a column cuts has the ends on the line of what was bought and sold up to each chunk. The running
    values are written once, since both the chunks' totals and the lots are read from them."""
    buy, q = F.col("side") == "BUY", F.col("__q")
    rows = orders.select("symbol", "side", parts_of(F.col("quantity")).alias("__q"), "quantity", "price", "fees", "order_date", "seq").where("__q > 0")
    unit = F.col("price") + F.when(buy, F.col("fees")).otherwise(-F.col("fees")) / F.col("quantity")
    rows = scan.deal(rows.select("symbol", F.when(buy, q).otherwise(-q).alias("__q"), unit.alias("unit"), "order_date", "seq"), bounds, "symbol", "seq")
    chunk = W.partitionBy("symbol", "chunk").orderBy("seq")
    way = chunk.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"__s": F.sum(q).over(way), "__b": F.sum(F.greatest(q, F.lit(0))).over(way)}).withColumn("__m", F.min("__s").over(way)).withColumn("__m1", F.lag("__m").over(chunk))

    if bounds is not None:
        rows = scratch.keep(rows, "lots", compression="zstd")
        total = rows.groupBy("symbol", "chunk").agg(F.sum(q).alias("s"), F.min("__m").alias("m"), F.max("__b").alias("b"))
        before, all_of = scan.earlier("symbol"), W.partitionBy("symbol")
        total = total.withColumns({"s0": F.coalesce(F.sum("s").over(before), F.lit(0)), "b0": F.coalesce(F.sum("b").over(before), F.lit(0))}).withColumn("__low", F.col("s0") + F.col("m"))
        total = total.withColumn("m0", F.least(F.lit(0), F.min("__low").over(before)))
        total = total.withColumns({"__bought": F.col("b0") + F.col("b"), "__sold": F.col("b0") + F.col("b") - F.col("s0") - F.col("s") + F.least("m0", "__low")})
        total = total.withColumns({"matched": F.max("__sold").over(all_of), "cuts": F.sort_array(F.array_distinct(F.concat(F.collect_list("__bought").over(all_of), F.collect_list("__sold").over(all_of))))})
        inside = F.filter("cuts", lambda x: (x > 0) & (x < F.col("matched")))
        total = scratch.keep(total.select("symbol", "chunk", "s0", "b0", "m0", "matched", inside.alias("cuts")), "totals")
        rows = rows.join(F.broadcast(total), ["symbol", "chunk"])
    else:
        rows = rows.withColumns({"s0": F.lit(0), "b0": F.lit(0), "m0": F.lit(0)})
    buy = q > 0
    rows = rows.withColumns({"__held": F.col("s0") + F.col("__s") - F.least("m0", F.col("s0") + F.col("__m")), "__was": F.col("s0") + F.col("__s") - q - F.least("m0", F.col("s0") + F.col("__m1"))})
    if bounds is None:
        rows = rows.withColumn("matched", F.max(F.col("__b") - F.col("__held")).over(W.partitionBy("symbol", "chunk")))
    size, end = F.when(buy, q).otherwise(F.col("__was") - F.col("__held")), F.col("b0") + F.col("__b") - F.when(buy, F.lit(0)).otherwise(F.col("__held"))
    rows = rows.select("symbol", F.when(buy, "BUY").otherwise("SELL").alias("side"), (end - size).alias("start"), end.alias("end"), "unit", "order_date", "seq", "matched", *(["cuts"] if bounds is not None else []))
    return rows.where("end > start")


def fifo(orders: DataFrame) -> DataFrame:
    """Matched pieces of buys and sells, first in, first out: symbol, year, quantity, parts (whole billionths), cost and proceeds (whole millionths), sell, sell_date, buy, buy_date, at (the piece's end on the symbol's line).

    The end points of both kinds of intervals cut the line into pieces with one buy and one sell each: the nearest of either
    kind at or behind the piece's end. A long line is cut at end points (so that no piece is), and an interval goes to every
    chunk that it reaches into, up to that chunk's end: a chunk needs none of the others."""
    bounds = scan.bounds(orders, "symbol", "seq")
    rows = lots(orders, bounds).where("start < matched").withColumn("end", F.least("end", "matched"))
    buy = F.col("side") == "BUY"
    # a column for either side, so that what isn't asked for isn't shuffled
    flat = {f"{s}_{c}": F.when(own, F.col(c)) for s, own in (("b", buy), ("s", ~buy)) for c in ("seq", "unit", "order_date")}
    if bounds is not None:
        upto = lambda c, of: F.size(F.filter(c, of))
        reach = F.sequence(upto("cuts", lambda x: x <= F.col("start")), upto("cuts", lambda x: x < F.col("end")))
        rows = rows.withColumn("chunk", F.explode(reach)).withColumn("end", F.least("end", F.get("cuts", F.col("chunk"))))
        first = F.coalesce(F.get("cuts", F.col("chunk") - 1), F.lit(0))
        rows = rows.select("symbol", "chunk", "side", "end", first.alias("__from"), *[x.alias(c) for c, x in flat.items()]).repartition("symbol", "chunk")
    else:
        rows = rows.select("symbol", F.lit(0).alias("chunk"), "side", "end", F.lit(0).alias("__from"), *[x.alias(c) for c, x in flat.items()])
    line = W.partitionBy("symbol", "chunk").orderBy(F.desc("end"), F.desc("side"))
    nearest = lambda s, c: F.last(F.when(F.col("side") == ("BUY" if s == "b" else "SELL"), F.struct(f"{s}_{c}")), True).over(line.rowsBetween(W.unboundedPreceding, 0))[f"{s}_{c}"]
    q = F.col("parts") / PARTS
    rows = rows.select(
        "symbol", "chunk", F.col("end").alias("at"), (F.col("end") - F.coalesce(F.lead("end").over(line), "__from")).alias("parts"), *[nearest(s, c).alias(f"{s}_{c}") for s in "bs" for c in ("seq", "unit", "order_date")],
        *[F.max(F.col("side") == side).over(line.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c, side in (("__bought", "BUY"), ("__sold", "SELL"))],
    )
    return rows.where("parts > 0 AND __bought AND __sold").select(
        "symbol", F.year("s_order_date").alias("year"), q.alias("quantity"), "parts", micro(q * F.col("b_unit")).alias("cost"), micro(q * F.col("s_unit")).alias("proceeds"),
        F.col("s_seq").alias("sell"), F.col("s_order_date").alias("sell_date"), F.col("b_seq").alias("buy"), F.col("b_order_date").alias("buy_date"), "at",
    )


#: Tax on gains in percent.
RATES = {"bond": 12.5, "standard": 26.0}


def category(asset_type: Column) -> Column:
    return F.when(asset_type.isin("bond", "bond_etf"), "bond").otherwise("standard")


def tax_events(pieces: DataFrame, assets: DataFrame) -> DataFrame:
    """One row a matched sell: quantity, cost, proceeds and gain (to cents), rate, and days held since its last lot was bought."""
    out = pieces.groupBy("symbol", "sell", "sell_date", "year").agg((F.sum("parts") / PARTS).alias("quantity"), F.sum("cost").alias("__c"), F.sum("proceeds").alias("__p"), F.max_by("buy_date", "at").alias("opened"))
    out = out.join(F.broadcast(assets.select("symbol", "asset_type")), "symbol").withColumn("category", category(F.col("asset_type")))
    out = out.withColumns({"cost": cents_of(F.col("__c")), "proceeds": cents_of(F.col("__p")), "gain": cents_of(F.col("__p") - F.col("__c")), "holding_days": holding_days(F.col("opened"), F.col("sell_date"))})
    return out.withColumn("rate", F.when(F.col("category") == "bond", RATES["bond"]).otherwise(RATES["standard"])).drop("__c", "__p", "opened")


def tax(events: DataFrame) -> DataFrame:
    """Per category and year: gains, losses, losses used and carried on, tax. ``events``: category, year, gain (to cents); years without a category's events carry its losses on."""
    whole = lambda x: F.sum(F.floor(x * 100 + 0.5).cast("long"))
    rows = events.groupBy("category", "year").agg(whole(F.greatest("gain", F.lit(0.0))).alias("g"), whole(F.greatest(-F.col("gain"), F.lit(0.0))).alias("l"))
    spine = rows.select("year").distinct().select("year", F.explode(F.array(*map(F.lit, sorted(RATES)))).alias("category"))
    rows = spine.join(rows, ["category", "year"], "left").withColumns({"g": F.coalesce("g", F.lit(0)), "l": F.coalesce("l", F.lit(0))})
    way = W.partitionBy("category").orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__c", F.sum(F.col("l") - F.col("g")).over(way))
    rows = rows.withColumn("__carry", F.col("__c") - F.least(F.lit(0), F.min("__c").over(way)))
    there = F.col("l") + F.coalesce(F.lag("__carry").over(W.partitionBy("category").orderBy("year")), F.lit(0))
    due = F.greatest(F.col("g") - there, F.lit(0)) * F.when(F.col("category") == "bond", RATES["bond"]).otherwise(RATES["standard"]) / 10_000
    return rows.select("category", "year", (F.col("g") / 100).alias("gains"), (F.col("l") / 100).alias("losses"), (F.least("g", there) / 100).alias("used"), (F.col("__carry") / 100).alias("carry"), due.alias("tax"))


def tax_years(taxed: DataFrame) -> DataFrame:
    """All categories of a year together."""
    out = taxed.groupBy("year").agg(*[F.round(F.sum(c), 2).alias(c) for c in ("gains", "losses", "used", "carry", "tax")])
    return out.withColumn("net", F.round(F.col("gains") - F.col("losses"), 2))


def open_lots(orders: DataFrame, prices: DataFrame, assets: DataFrame) -> DataFrame:
    """What is left of all buys after first in, first out: quantity, cost, value and unrealised gain at the latest price, to cents."""
    left = F.col("end") - F.greatest("start", "matched")
    rows = lots(orders, scan.bounds(orders, "symbol", "seq")).where("side = 'BUY' AND end > matched").groupBy("symbol").agg((F.sum(left) / PARTS).alias("quantity"), F.sum(micro(left / PARTS * F.col("unit"))).alias("__c"))
    rows = rows.join(prices.select("symbol", "close"), "symbol", "left").join(assets.select("symbol", "asset_type"), "symbol", "left")
    worth = micro(F.col("quantity") * F.when(F.col("close") != 0, F.col("close")))
    return rows.select("symbol", "asset_type", "quantity", cents_of(F.col("__c")).alias("cost"), cents_of(worth).alias("value"), cents_of(worth - F.col("__c")).alias("unrealized"))


def paper_account(orders: DataFrame, initial: float) -> DataFrame:
    """Cash after each order of a log that is taken as it is: net amount (fees included) and running cash, by seq, of each ``account``.

    Orders that lack cash or quantity aren't refused here; ``short`` marks them."""
    way = W.partitionBy("account").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    gross = F.col("price") * F.col("quantity")
    out = orders.withColumn("net", F.when(F.col("side") == "BUY", gross + F.col("fees")).otherwise(gross - F.col("fees")))
    out = out.withColumn("cash", initial - F.sum(F.when(F.col("side") == "BUY", F.col("net")).otherwise(-F.col("net"))).over(way))
    return out.withColumn("short", F.col("cash") < 0)
