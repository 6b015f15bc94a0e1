"""Holdings from a CSV file that people keep: headers in two languages, numbers in either form, errors by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.text import parse_number

#: Names that headers go by.
HEADERS = {
    "symbol": ("symbol", "ticker", "simbolo"),
    "name": ("name", "nome", "descrizione", "description"),
    "asset_type": ("asset_type", "tipo", "type", "assettype"),
    "quantity": ("quantity", "quantita", "quantità", "qty", "shares", "quote", "numero"),
    "average_price": ("average_price", "avg_price", "averageprice", "prezzo_medio", "prezzomedio", "prezzo medio", "pmc", "costo_medio"),
    "currency": ("currency", "valuta", "ccy"),
}
REQUIRED = ("symbol", "quantity", "average_price")
#: Fixed values.
ASSET_TYPES = ("stock", "etf", "crypto", "bond", "bond_etf", "macro", "bond_proxy")


def _plain(header: str) -> str:
    return " ".join((header or "").lower().replace("_", " ").split())


def columns_of(headers: list[str]) -> dict[str, int]:
    """The place of each known field, the first header that names it; an error tells which required ones are missing."""
    names = {_plain(alias): field for field, aliases in HEADERS.items() for alias in aliases}
    found: dict[str, int] = {}
    for k, h in enumerate(headers):
        if (field := names.get(_plain(h))) is not None:
            found.setdefault(field, k)
    if missing := [f for f in REQUIRED if f not in found]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return found


def holdings(rows: DataFrame, headers: list[str]) -> DataFrame:
    """symbol, name, asset_type, quantity, average_price, currency, error of rows with an array column ``cells``.

    Rows without a symbol and readable rows without a positive quantity are left out; a row whose numbers can't be
    read stays with what is wrong in ``error``. Missing or unknown types are stock, missing currencies EUR."""
    at = columns_of(headers)
    cell = lambda f: F.trim(F.coalesce(F.get("cells", F.lit(at[f])), F.lit(""))) if f in at else F.lit("")
    kind = F.replace(F.lower(cell("asset_type")), F.lit(" "), F.lit("_"))
    read = F.struct(
        F.upper(cell("symbol")).alias("symbol"), cell("name").alias("name"), F.when(kind.isin(*ASSET_TYPES), kind).otherwise("stock").alias("asset_type"),
        parse_number(cell("quantity")).alias("quantity"), parse_number(cell("average_price")).alias("average_price"), F.left(F.upper(cell("currency")), F.lit(8)).alias("currency"),
    )
    out = rows.select(F.inline(F.array(read)))  # read once: as plain columns the conditions below would read the numbers anew each
    wrong = F.concat_ws(",", F.when(F.col("quantity").isNull(), "quantity"), F.when(F.col("average_price").isNull(), "average_price"))
    out = out.where("symbol != ''").withColumn("error", F.when(wrong != "", F.concat(F.lit("not a number: "), wrong))).where("error IS NOT NULL OR quantity > 0")
    blank = lambda c, other: F.when(F.col(c) != "", F.col(c)).otherwise(other)
    return out.withColumns({"name": blank("name", F.col("symbol")), "currency": blank("currency", F.lit("EUR")), "quantity": F.round("quantity", 6), "average_price": F.round("average_price", 6)})


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Holdings of a CSV file with a header line."""
    plain = spark.read.option("header", False).option("quote", '"').option("escape", '"').csv(path)
    headers = list(plain.first() or [])
    body = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(", ".join(f"_c{k} string" for k in range(len(headers)))).option("enforceSchema", True).csv(path)
    return holdings(body.select(F.array(*body.columns).alias("cells")), headers)


def missing_assets(held: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets to add for holdings of symbols that aren't known yet, one row a symbol."""
    new = held.where("error IS NULL").join(assets.select(F.upper("symbol").alias("symbol")), "symbol", "left_anti")
    return new.groupBy("symbol").agg(F.min(F.struct("name", "asset_type", "currency")).alias("x")).select("symbol", "x.*", F.lit("medium").alias("risk_level"))
