"""Demonstration rows for use without vendors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentiment, label and relevance of an asset's three items, and hours between them.
ITEMS = ((0.42, "POSITIVE", 82.0), (-0.34, "NEGATIVE", 68.0), (0.02, "NEUTRAL", 54.0))
HOURS = 7
TITLES = ("{} grows its sales, outlook under review", "{} in the focus of regulators", "{} unchanged ahead of its figures")


def news(assets: DataFrame, day: str) -> DataFrame:
    """Three items an asset, the first at noon of ``day``, the others HOURS apart before it; no row for a null symbol."""
    before, after = zip(*(t.split("{}") for t in TITLES))
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("place"), F.concat(F.lit(before[k]), F.upper("symbol"), F.lit(after[k])).alias("title"), F.lit(score).alias("sentiment_score"), F.lit(label).alias("sentiment_label"), F.lit(relevance).alias("relevance_score"),
            F.concat(F.lit("demo://news/"), F.lower("symbol"), F.lit(f"/{k}")).alias("url"), (F.lit(f"{day} 12:00:00").cast("timestamp_ntz") - F.expr(f"INTERVAL {HOURS * k} HOURS")).alias("published_at"),
        )
        for k, (score, label, relevance) in enumerate(ITEMS)
    ])
    return assets.where("symbol IS NOT NULL").select("symbol", F.explode(rows).alias("x")).select("symbol", "x.*")
