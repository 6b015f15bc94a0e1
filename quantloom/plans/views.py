"""Canonical views of the analytics over the driver's tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import indicators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column, digits: int) -> Column:
    """Rounded half up in plain double arithmetic, which other engines repeat bit for bit."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset a brand: symbol, name, asset_type, currency, risk_level."""
    first = F.min_by(F.struct("p_name", "p_type", "p_size"), F.col("p_partkey")).alias("x")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg(first, F.min("p_partkey").alias("k"))
    kind = F.col("x.p_type")
    return rows.select(
        "symbol", F.col("x.p_name").alias("name"),
        F.when(kind.isin("STANDARD", "PROMO"), "stock").when(kind == "ECONOMY", "etf").when(kind == "MEDIUM", "bond").when(kind == "SMALL", "crypto").otherwise("bond_etf").alias("asset_type"),
        F.when(F.col("k") % 3 == 0, "EUR").when(F.col("k") % 3 == 1, "USD").otherwise("GBP").alias("currency"),
        F.when(F.col("x.p_size") < 13, "low").when(F.col("x.p_size") < 26, "medium").when(F.col("x.p_size") < 39, "high").otherwise("very_high").alias("risk_level"),
    )


def orders(spark: SparkSession, sf_dir: str, quantity: Column | None = None) -> DataFrame:
    """Order log: symbol, side, quantity (whole, where no other is given), price, fees, order_date and the key seq that orders it."""
    quantity = F.col("l_quantity") if quantity is None else quantity
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = cents(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    return rows.select(
        F.col("p_brand").alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), quantity.alias("quantity"), price.alias("price"),
        cents(price * quantity * F.col("l_tax") / 100, 2).alias("fees"), F.to_date("l_shipdate").alias("order_date"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
    )


def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order log with fractional quantities, some of them 0."""
    return orders(spark, sf_dir, F.col("l_quantity") * F.col("l_discount"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars a brand: symbol, date, open, high, low, close, volume, prepared for the indicators."""
    return indicators.prepare(bars(orders(spark, sf_dir).select("symbol", F.to_date(F.date_trunc("week", "order_date")).alias("date"), "seq", "price", "quantity")))


def bars(ticks: DataFrame) -> DataFrame:
    """OHLCV of ticks (symbol, date, seq, price, quantity): one partial aggregate, one shuffle."""
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("quantity").alias("volume")
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net holdings of the order log at average cost: symbol, quantity, average_price, invested_amount."""
    buy = F.col("side") == "BUY"
    rows = orders(spark, sf_dir).groupBy("symbol").agg(
        F.sum(F.when(buy, F.col("quantity")).otherwise(-F.col("quantity"))).alias("quantity"),
        (F.sum(F.when(buy, F.col("price") * F.col("quantity") + F.col("fees"))) / F.sum(F.when(buy, F.col("quantity")))).alias("average_price"),
    )
    rows = rows.where("quantity > 0").select("symbol", "quantity", cents(F.col("average_price"), 4).alias("average_price"))
    return rows.withColumn("invested_amount", F.col("quantity") * F.col("average_price"))


def cash(spark: SparkSession, sf_dir: str) -> Column:
    """The portfolio's cash: all customers' balances together, as one number."""
    return table(spark, sf_dir, "customer").agg(F.sum(F.floor(F.col("c_acctbal") * 100 + 0.5).cast("long")) / 100).scalar()


#: Words that occur in the documents stand in for the phrases of good and bad news.
NEWS_POSITIVE = ("inger", "oration", "elleou", "mentai")
NEWS_NEGATIVE = ("stnd", "hawh", "ouenaux", "zuung", "ciónas")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item a document: item_id, symbol, published_at, text, relevance."""
    day = F.date_add(F.lit("1999-01-04").cast("date"), (F.col("doc_id") * 7 % 700).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("symbol"),
        day.alias("published_at"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") * 13 % 101).cast("double").alias("relevance"),
    )


SQL = {
    "assets": """SELECT symbol, x.p_name AS name,
    CASE WHEN x.p_type IN ('STANDARD', 'PROMO') THEN 'stock' WHEN x.p_type = 'ECONOMY' THEN 'etf' WHEN x.p_type = 'MEDIUM' THEN 'bond' WHEN x.p_type = 'SMALL' THEN 'crypto' ELSE 'bond_etf' END AS asset_type,
    CASE WHEN k % 3 = 0 THEN 'EUR' WHEN k % 3 = 1 THEN 'USD' ELSE 'GBP' END AS currency,
    CASE WHEN x.p_size < 13 THEN 'low' WHEN x.p_size < 26 THEN 'medium' WHEN x.p_size < 39 THEN 'high' ELSE 'very_high' END AS risk_level
    FROM (SELECT p_brand AS symbol, min(p_partkey) AS k, arg_min(part, p_partkey) AS x FROM part GROUP BY p_brand)""",
    "trades": """SELECT p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, floor(l_extendedprice / l_quantity * 100 + .5::DOUBLE) / 100 AS price,
    floor(floor(l_extendedprice / l_quantity * 100 + .5::DOUBLE) / 100 * l_quantity * l_tax / 100 * 100 + .5::DOUBLE) / 100 AS fees, CAST(l_shipdate AS DATE) AS order_date,
    (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fractions": """SELECT symbol, side, quantity * l_discount AS quantity, price, floor(price * (quantity * l_discount) * l_tax / 100 * 100 + .5::DOUBLE) / 100 AS fees, order_date, seq FROM trades
    JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_discount, l_tax FROM lineitem) ON seq = (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)""",
    "prices": """SELECT symbol, CAST(date_trunc('week', order_date) AS DATE) AS date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
    sum(quantity) AS volume FROM trades GROUP BY ALL""",
    "positions": """SELECT *, quantity * average_price AS invested_amount FROM (
    SELECT symbol, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS quantity,
    floor(sum(price * quantity + fees) FILTER (WHERE side = 'BUY') / sum(quantity) FILTER (WHERE side = 'BUY') * 10000 + .5::DOUBLE) / 10000 AS average_price FROM trades GROUP BY symbol) WHERE quantity > 0""",
    "money": "SELECT sum(floor(c_acctbal * 100 + .5::DOUBLE)::BIGINT) / 100 AS cash FROM customer",
    "news": """SELECT doc_id AS item_id, 'Brand#' || (doc_id % 25 + 1)::VARCHAR AS symbol,
    DATE '1999-01-04' + (doc_id * 7 % 700)::INT AS published_at, coalesce(text, '') AS text, (doc_id * 13 % 101)::DOUBLE AS relevance FROM documents""",
}
_NEEDS = {"prices": ["trades"], "fractions": ["trades"], "positions": ["trades"]}


def sql(body: str, *names: str) -> str:
    """``body`` with the named views (and those they need) in front as common table expressions."""
    order: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    views = ",\n".join(f"{n} AS (\n    {SQL[n]})" for n in order)
    body = body.strip()
    if not order:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
