"""Paper accounts: orders are refused where cash or holding lacks.

Whether an order is taken depends on every one taken before it, so no window can tell. Accounts are dealt to tasks
and sorted by order; a task streams over its rows and keeps the state of one account at a time (cash, and what it
holds of each symbol), so memory doesn't grow with an account's orders.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .portfolio import cents_of, micro

TAKEN, NO_CASH, NO_HOLDING, INVALID = "SIMULATED", "NO_CASH", "NO_HOLDING", "INVALID"
ADDED = "status string, cash double, held double, average_price double, invested double, realized double"


def execute(orders: DataFrame, initial: float, fee_percent: float = 0.1) -> DataFrame:
    """Every order (account, seq, symbol, side, quantity, price, fees) with gross and net amount, its status, and the account after it: cash, the symbol's holding, average price and invested amount, and the order's realised gain.

    Null fees are ``fee_percent`` of the gross amount. A purchase that costs more than the cash and a sale of more than is
    held are refused and change nothing; so are orders without price or positive quantity, or of another side. A null
    account is an account, a null symbol a symbol; ``seq`` decides the order within an account."""
    gross = F.col("quantity") * F.col("price")
    rows = orders.select("account", "seq", "symbol", "side", F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"), F.coalesce(F.col("fees").cast("double"), gross * (fee_percent / 100)).alias("fees"))
    rows = rows.withColumn("gross", gross).withColumn("net", F.when(F.col("side") == "BUY", F.col("gross") + F.col("fees")).otherwise(F.col("gross") - F.col("fees")))
    names = rows.columns

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        began, account, cash, book = False, None, initial, {}
        for b in batches:
            seen = [b.column(names.index(c)).to_pylist() for c in ("account", "symbol", "side", "quantity", "price", "fees", "gross", "net")]
            out = []
            for owner, symbol, side, quantity, price, fees, gross, net in zip(*seen):
                if not began or owner != account:
                    began, account, cash, book = True, owner, initial, {}
                held, average, invested = book.get(symbol, (0.0, 0.0, 0.0))
                status, realized = TAKEN, 0.0
                if gross is None or quantity <= 0 or side not in ("BUY", "SELL"):
                    status = INVALID
                elif side == "BUY":
                    if cash < net:
                        status = NO_CASH
                    else:
                        invested = invested + gross + fees
                        held = held + quantity
                        average, cash = invested / held, cash - net
                elif held < quantity:
                    status = NO_HOLDING
                else:
                    realized = (price - average) * quantity - fees
                    held, cash = held - quantity, cash + net
                    invested = max(0.0, invested - average * quantity) if held > 0 else 0.0
                if status == TAKEN:
                    book[symbol] = held, average, invested
                out.append((status, cash, held, average, invested, realized))
            kinds = [pa.string()] + [pa.float64()] * 5
            added = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*names, *(x.split()[0] for x in ADDED.split(", "))])

    schema = rows.limit(0).selectExpr("*", *[f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in ADDED.split(", ")]).schema
    return rows.repartition("account").sortWithinPartitions("account", "seq").mapInArrow(run, schema)


def holdings(executed: DataFrame) -> DataFrame:
    """What each account holds at the end, and what it has realised (to cents) with each symbol, sold out ones left out."""
    taken = executed.where(F.col("status") == TAKEN)
    last = F.max_by(F.struct("held", "average_price", "invested"), "seq").alias("x")
    out = taken.groupBy("account", "symbol").agg(last, cents_of(F.sum(micro(F.col("realized")))).alias("realized")).select("account", "symbol", F.col("x.held").alias("quantity"), "x.average_price", F.col("x.invested").alias("invested_amount"), "realized")
    return out.where("quantity > 0")


def snapshots(executed: DataFrame, most: int = 20) -> DataFrame:
    """The last ``most`` states of each account, numbered upwards: cash and what has been realised so far (to cents)."""
    way = W.partitionBy("account").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    taken = executed.where(F.col("status") == TAKEN).withColumn("total_realized", cents_of(F.sum(micro(F.col("realized"))).over(way)))
    late = taken.withColumn("__k", F.row_number().over(W.partitionBy("account").orderBy(F.desc("seq")))).where(F.col("__k") <= most)
    return late.withColumn("place", F.row_number().over(W.partitionBy("account").orderBy("seq"))).select("account", "place", "seq", "cash", "total_realized")
