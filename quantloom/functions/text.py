"""Text column functions: numbers as people write them, keyword sentiment, impact, label encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of good and bad news.
POSITIVE = ("earnings beat", "revenue growth", "raises guidance", "upgrade", "partnership", "approval", "buyback", "dividend increase")
NEGATIVE = ("earnings miss", "revenue decline", "lawsuit", "downgrade", "investigation", "recall", "bankruptcy", "guidance cut", "regulatory risk")


#: A number in digits, with a sign, a fraction or an exponent.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(text: Column) -> Column:
    """Numbers in European or American form; blank is 0, what can't be read is NULL.

    The text without its signs of currency is an array of one, so that it is made once for all its uses."""
    number = lambda x: F.regexp_extract(x, NUMBER, 0).try_cast("double")  # noqa: E731  a cast alone takes 12d and NaN too

    def read(bare: Column) -> Column:
        dots, commas = (F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit(""))) for c in ".,")
        comma_last = F.length(bare) - F.instr(F.reverse(bare), ",") > F.length(bare) - F.instr(F.reverse(bare), ".")
        no_commas = F.replace(bare, F.lit(","), F.lit(""))
        decimal_comma = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        grouped = F.when(bare.rlike(r"^[^.]*(\.[^.]{3})+$"), F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
        usual = (
            F.when((dots > 0) & (commas > 0), F.when(comma_last, decimal_comma).otherwise(no_commas))
            .when(commas == 1, decimal_comma).when(commas > 1, no_commas).when(dots > 1, grouped).otherwise(bare)
        )
        return F.when(F.coalesce(bare, F.lit("")) == "", 0.0).otherwise(F.get(F.filter(F.transform(F.array(bare, usual), number), lambda x: F.abs(x) < float("inf")), F.lit(0)))

    return F.get(F.transform(F.array(F.regexp_replace(F.trim(text), "[€$£  ]", "")), read), F.lit(0))


def hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur, each counted once."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(lower, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def sentiment(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """struct<score, label> from phrase hits: .32 each, .12 more where all point one way, within -1 and 1."""
    up, down = hits(text, positive), hits(text, negative)
    raw = (up - down) * 0.32 + F.when((up > 0) & (down == 0), 0.12).when((down > 0) & (up == 0), -0.12).otherwise(0.0)
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)), 3)
    return F.struct(score.alias("score"), sentiment_label(score).alias("label"))


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.15, "POSITIVE").when(score <= -0.15, "NEGATIVE").otherwise("NEUTRAL")


def impact(relevance: Column, score: Column, keyword_hits: Column) -> Column:
    r, s = F.coalesce(relevance, F.lit(0)), F.abs(F.coalesce(score, F.lit(0)))
    high = ((r >= 80) & ((s >= 0.4) | (keyword_hits >= 1))) | ((r >= 65) & (s >= 0.55))
    return F.when(high, "HIGH").when((r >= 50) | (s >= 0.25) | (keyword_hits >= 1), "MEDIUM").otherwise("LOW")


def encode_label(label: Column) -> Column:
    """+1, -1 or 0; the positive test comes first, so NON_POSITIVE_RETURN is +1 and UNDERPERFORM, which has no OUTPERFORM in it, -1."""
    up, has = F.upper(F.coalesce(label, F.lit(""))), lambda x: F.contains(up, F.lit(x))
    return F.when(has("POSITIVE") | has("OUTPERFORM"), 1).when(has("DRAWDOWN") | has("UNDER") | has("NON_"), -1).otherwise(0)


def contains_any(query: str, *cols: Column) -> Column:
    """Free-text filter over several columns, without regard to case."""
    return F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(query.lower()))


def market_mood(news: DataFrame, day: str, days: int = 7) -> DataFrame:
    """One row on all items (score, label, impact, published_at) of the ``days`` before ``day`` on, and those without a date: count, mean, label, strongest impact and counts of labels."""
    rows = news.where(F.col("published_at").isNull() | (F.col("published_at") >= F.date_sub(F.lit(day).cast("date"), days)))
    told = lambda x: F.count_if(F.col("label") == x)
    strong = F.max(F.when(F.col("impact") == "HIGH", 3).when(F.col("impact") == "MEDIUM", 2).otherwise(1))
    out = rows.agg(F.count(F.lit(1)).alias("news_count"), F.coalesce(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 4), F.lit(0.0)).alias("average_sentiment"), strong.alias("__s"), told("POSITIVE").alias("positive"), told("NEGATIVE").alias("negative"), told("NEUTRAL").alias("neutral"))
    level = F.when(F.col("__s") == 3, "HIGH").when(F.col("__s") == 2, "MEDIUM").otherwise("LOW")
    return out.withColumns({"sentiment_label": sentiment_label(F.col("average_sentiment")), "impact_level": level}).drop("__s")
