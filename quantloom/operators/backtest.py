"""Strategy simulation: one group a run, all runs of a comparison or walk-forward in one job.

Cash, holdings and stops depend on every day before, so a run's days are one Arrow group.
Spark windows find the days of rebalancing and rank and pick each one's candidates; a group
has only the symbols that were candidates once, and of each day the best symbol so that no
day is missing. Holding takes every symbol of its first day, so all stay there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRATEGIES = ("BUY_AND_HOLD", "SCORE_THRESHOLD", "TOP_N_SCORE")
CASH = 100_000.0


def asof_grid(bars: DataFrame, *values: str) -> DataFrame:
    """For each date and symbol the last row up to that date; symbols without one aren't there yet."""
    days = bars.select(F.collect_set("date").alias("days")).scalar()  # one array, as long as there are dates
    first = bars.groupBy("symbol").agg(F.min("date").alias("__first")).withColumn("__days", days)
    grid = first.select("symbol", F.explode(F.filter("__days", lambda d: d >= F.col("__first"))).alias("date"))
    way = W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = grid.join(bars.select("symbol", "date", F.struct(*values).alias("__x")), ["symbol", "date"], "left")
    return rows.withColumn("__x", F.last("__x", True).over(way)).where("__x IS NOT NULL").select("symbol", "date", "__x.*")


def folds(dates: DataFrame, n: int) -> DataFrame:
    """Equal contiguous slices of the dates, the last takes what remains; fewer than two dates a slice are refused by an error."""
    rank = F.row_number().over(W.orderBy("date")) - 1  # one row a trading day
    total = dates.agg(F.count(F.lit(1))).scalar()
    size = F.when(total >= 2 * n, F.floor(total / n)).otherwise(F.raise_error(F.lit(f"{n} folds need {2 * n} dates or more")).cast("long"))
    return dates.select("date", F.least(F.floor(rank / size), F.lit(n - 1)).cast("int").alias("fold"))


def candidates(rows: DataFrame) -> DataFrame:
    """Rows that a run can need, with ``pick``: what it may buy at a rebalance, its first day of each week."""
    first = F.min("date").over(W.partitionBy("run_id", F.date_trunc("week", "date")))
    wanted = F.when(F.col("strategy") == "TOP_N_SCORE", F.col("place") <= F.greatest("top", F.lit(1))).when(F.col("strategy") == "SCORE_THRESHOLD", F.col("score") >= F.col("buy")).otherwise(True)
    can = F.col("close").isNotNull() & (F.col("score").isNotNull() | (F.col("strategy") == "BUY_AND_HOLD"))
    rows = rows.withColumn("pick", F.coalesce((F.col("date") == first) & wanted & can, F.lit(False)))
    return rows.withColumn("__ever", F.max("pick").over(W.partitionBy("run_id", "symbol"))).where("__ever OR place = 1").drop("__ever")


def simulate(market: DataFrame, runs: DataFrame) -> DataFrame:
    """Equity of every run and day. ``market``: date, symbol, close, score; ``runs``: run_id, strategy, fold (null: all), buy, sell, top, most, fee, stop, take."""

    def run(pdf):
        import pandas as pd

        p = pdf.iloc[0]
        cash, held, cost, peak, key, out = CASH, {}, {}, CASH, None, []
        trades, wins = 0, 0

        def sell(symbol, price, part=1.0):
            nonlocal cash, trades, wins
            q = held[symbol] * part
            gain = q * price * (1 - p.fee / 100)
            cash += gain
            trades, wins = trades + 1, wins + (gain > q * cost[symbol])
            held[symbol] -= q
            if held[symbol] <= 1e-9:
                del held[symbol], cost[symbol]

        def buy(symbol, price, amount):
            nonlocal cash, trades
            spend = min(amount, cash)
            if spend <= 1e-9:
                return
            q = spend / (1 + p.fee / 100) / price
            had = held.get(symbol, 0.0)
            cost[symbol] = (had * cost.get(symbol, 0.0) + spend) / (had + q)
            held[symbol], cash, trades = had + q, cash - spend, trades + 1

        for day, rows in pdf.sort_values(["date", "place"]).groupby("date", sort=True):
            price, score = dict(zip(rows["symbol"], rows["close"])), dict(zip(rows["symbol"], rows["score"]))
            for s in list(held):
                if s in price and (price[s] <= cost[s] * (1 - p.stop / 100) or price[s] >= cost[s] * (1 + p["take"] / 100)):
                    sell(s, price[s])
            chosen = rows["symbol"][rows["pick"]].tolist()
            worth = lambda: cash + sum(q * price[s] for s, q in held.items())  # noqa: B023, E731
            week = day.isocalendar()[:2]
            if week != key:
                if p.strategy == "BUY_AND_HOLD":
                    amount = worth() * min(p.most, 1 / int(rows["listed"].iloc[0]))
                    for s in sorted(chosen) if key is None else ():
                        buy(s, price[s], amount)
                else:
                    for s in list(held):
                        if s not in chosen if p.strategy == "TOP_N_SCORE" else score[s] <= p.sell:
                            sell(s, price[s])
                    weight = min(p.most, 1 / max(len(chosen), 1)) if p.strategy == "TOP_N_SCORE" else p.most
                    for s in chosen:
                        target, own = worth() * weight, held.get(s, 0.0) * price[s]
                        if p.strategy == "TOP_N_SCORE" and own > target * 1.05:
                            sell(s, price[s], (own - target) / own)
                        else:
                            buy(s, price[s], target - own)
                key = week
            equity = worth()
            peak = max(peak, equity)
            out.append((p.run_id, day, equity, cash, (equity / peak - 1) * 100, trades, wins))
        return pd.DataFrame(out, columns=["run_id", "date", "equity", "cash", "drawdown", "trades", "wins"])

    day = W.partitionBy("date")
    market = market.withColumns({"place": F.row_number().over(day.orderBy(F.desc("score"), "symbol")), "listed": F.count(F.lit(1)).over(day)})
    rows = market.join(F.broadcast(runs), F.col("run_fold").isNull() | (F.col("run_fold") == F.col("fold")))  # a row a run
    return candidates(rows).groupBy("run_id").applyInPandas(run, "run_id string, date date, equity double, cash double, drawdown double, trades long, wins long")


def metrics(equity: DataFrame) -> DataFrame:
    """Return, CAGR, Sharpe ratio (0 where undefined), largest drawdown and place among the runs."""
    rows = equity.withColumn("__r", F.try_divide("equity", F.lag("equity").over(W.partitionBy("run_id").orderBy("date"))) - 1)
    out = rows.groupBy("run_id").agg(
        F.max_by("equity", "date").alias("final"), F.avg("__r").alias("__m"), F.stddev_samp("__r").alias("__s"), F.min("drawdown").alias("max_drawdown"),
        F.max("trades").alias("trades"), F.max("wins").alias("wins"), (F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1)) / 365.25).alias("years"),
    )
    out = out.withColumns({"total_return": (F.col("final") / CASH - 1) * 100, "cagr": (F.pow(F.col("final") / CASH, 1 / F.col("years")) - 1) * 100, "sharpe": F.coalesce(F.try_divide("__m", "__s") * (252**0.5), F.lit(0.0))})
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("total_return"), "run_id"))).drop("__m", "__s", "years")


def benchmark(grid: DataFrame, symbol: str) -> DataFrame:
    """date, benchmark_value (of CASH put into ``symbol`` on its first day) and benchmark_return in percent, from the as-of grid."""
    rows = grid.where(F.col("symbol") == symbol).select("date", "close")
    first = rows.agg(F.min_by("close", "date")).scalar()
    gain = F.coalesce((F.col("close") / F.when(first != 0, first) - 1) * 100, F.lit(0.0))
    return rows.select("date", gain.alias("benchmark_return"), (CASH * (1 + gain / 100)).alias("benchmark_value"))


def with_alpha(measured: DataFrame, equity: DataFrame, bench: DataFrame) -> DataFrame:
    """metrics() with the benchmark's return over a run's own dates, rebased to their first, and what the run made beyond it."""
    rows = equity.select("run_id", "date").join(bench, "date")
    over = rows.groupBy("run_id").agg(((F.max_by("benchmark_value", "date") / F.min_by("benchmark_value", "date") - 1) * 100).alias("benchmark_return"))
    out = measured.join(over, "run_id", "left").withColumn("benchmark_return", F.coalesce("benchmark_return", F.lit(0.0)))
    return out.withColumn("alpha", F.col("total_return") - F.col("benchmark_return"))


def verdict(measured: DataFrame) -> DataFrame:
    """What a walk-forward's runs (total_return, alpha) say together: spread of returns, and ROBUST, FRAGILE or UNCERTAIN."""
    c = F.col
    out = measured.agg(
        F.count(F.lit(1)).alias("folds"), F.avg("total_return").alias("mean_return"), F.median("total_return").alias("median_return"), F.coalesce(F.stddev_samp("total_return"), F.lit(0.0)).alias("std_return"),
        F.min("total_return").alias("worst"), F.max("total_return").alias("best"), F.count_if(c("total_return") > 0).alias("positive"), F.count_if(c("alpha") > 0).alias("beating"), F.avg("alpha").alias("mean_alpha"),
    )
    share = c("positive") / F.greatest(c("folds"), F.lit(1))
    said = F.when(c("folds") == 0, "FRAGILE").when((share >= 0.7) & (c("mean_alpha") > 0), "ROBUST").when((share <= 0.4) | (c("mean_return") <= 0), "FRAGILE").otherwise("UNCERTAIN")
    return out.withColumn("verdict", said)


def side_by_side(curves: DataFrame, *names: str) -> DataFrame:
    """Curves (run_id, date, equity; one row a run and date) as a column a run, null where a run has no such date."""
    return curves.groupBy("date").pivot("run_id", list(names)).agg(F.max("equity"))


#: Slippage a side and stamp duty a year in percent.
SLIPPAGE, STAMP = 0.05, 0.2


def net_analysis(trades: DataFrame, equity: DataFrame, assets: DataFrame) -> DataFrame:
    """What is left of each run after taxes on realised gains by class, slippage and stamp duty on the mean equity.

    ``trades``: run_id, symbol, side, gross, fees, pnl; unrealised gains aren't taxed; classes offset losses within themselves only."""
    bond = F.col("asset_type").isin("bond", "bond_etf")
    sold = F.when(F.col("side") == "SELL", F.col("pnl")).otherwise(0.0)
    rows = trades.join(assets.select("symbol", "asset_type"), "symbol", "left").groupBy("run_id").agg(
        F.sum("fees").alias("commission"), (F.sum(F.abs("gross")) * SLIPPAGE / 100).alias("slippage"),
        F.greatest(F.sum(F.when(bond, sold).otherwise(0.0)), F.lit(0.0)).alias("bonds"), F.greatest(F.sum(F.when(bond, 0.0).otherwise(sold)), F.lit(0.0)).alias("others"),
    )
    held = equity.groupBy("run_id").agg(F.max_by("equity", "date").alias("final"), F.avg("equity").alias("mean"), (F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1)) / 365.25).alias("years"))
    out = held.join(rows, "run_id", "left").fillna(0.0, ["commission", "slippage", "bonds", "others"])
    out = out.withColumns({"taxable": F.col("bonds") + F.col("others"), "tax": F.col("others") * 0.26 + F.col("bonds") * 0.125, "stamp_duty": F.col("mean") * STAMP / 100 * F.col("years")})
    out = out.withColumn("net_final", F.col("final") - F.col("tax") - F.col("slippage") - F.col("stamp_duty"))
    out = out.withColumns({"net_return": (F.col("net_final") / CASH - 1) * 100, "effective_rate": F.coalesce(F.try_divide(F.col("tax") * 100, F.col("taxable")), F.lit(0.0))})
    return out.select("run_id", "final", "commission", "slippage", "taxable", "tax", "stamp_duty", "net_final", "net_return", "effective_rate")


def trade_measures(trades: DataFrame) -> DataFrame:
    """Win rate in percent and profit factor (999 without a loss, 0 without a gain) of each run's sales."""
    sold = trades.where("side = 'SELL'").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sells"), (F.count_if(F.col("pnl") > 0) * 100 / F.count(F.lit(1))).alias("win_rate"),
        F.sum(F.greatest("pnl", F.lit(0.0))).alias("won"), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0))).alias("lost"),
    )
    factor = F.when(F.col("lost") > 0, F.col("won") / F.col("lost")).when(F.col("won") > 0, 999.0).otherwise(0.0)
    return sold.withColumn("profit_factor", factor)


def hold(grid: DataFrame, run_id: str, most: float = 1.0, fee: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Equity and trades of buying every symbol of the first day once and keeping it: plain sums, no simulation."""
    first = grid.agg(F.min("date")).scalar()
    start = grid.where((F.col("date") == first) & (F.col("close") > 0)).select("symbol", F.col("close").alias("paid"))
    n = start.agg(F.count(F.lit(1))).scalar()
    spend = CASH * F.least(F.lit(most), 1 / n)
    bought = start.withColumn("quantity", spend / (1 + fee / 100) / F.col("paid"))
    rows = grid.join(bought, "symbol").groupBy("date").agg(F.sum(F.col("quantity") * F.col("close")).alias("held"))
    equity = rows.select(F.lit(run_id).alias("run_id"), "date", (F.col("held") + CASH - spend * n).alias("equity"), (CASH - spend * n).alias("cash"))
    trades = bought.select(F.lit(run_id).alias("run_id"), "symbol", F.lit("BUY").alias("side"), spend.alias("gross"), (spend - F.col("quantity") * F.col("paid")).alias("fees"), F.lit(0.0).alias("pnl"))
    return equity, trades
