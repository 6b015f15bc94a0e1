"""Mixing sources to target weights by capped water-filling, native DataFrame operations only.

Sizes count words, a source's cap is ``epochs`` times its size. All open sources get
``weight * level``; sources above their cap are clamped to it and the level rises for
the rest until none is above. A source's target then becomes whole repetitions of
all its documents and one fractional repetition: the documents first in a seeded
order whose words come nearest to what is left. Only sums for each source and each
4,096th of the seeded order are ordered within one task, and the documents of the
one such bucket in which a source's cut falls.

Nulls: a null text has size 0, a null source is a source of its own (the last), a
null doc_id is ordered as the empty string. The seeded order is that of a hash of seed,
doc_id and text: rows that repeat a doc_id have places of their own, unless their texts
are the same too; these are taken or left together. No rows, no rows out. Long
texts count whole; mix() hands all columns on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _keys(doc_id: Column, source: Column, text: Column, seed: str) -> dict[str, Column]:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return {
        "__source": F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source.cast("string"))),
        "__key": key,
        "__bucket": F.conv(F.substring(key, 1, 3), 16, 10).cast("int"),
    }


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which weights, clamped at caps, sum to ``total``.

    Sources clamp in the order of cap / weight: with those before it clamped, the rest share what is left, and the first
    source that this doesn't lift above its cap has the level. One row reaches the driver."""
    c, before = F.col, W.orderBy(F.col("cap") / F.col("weight"), "__source").rowsBetween(W.unboundedPreceding, -1)  # a row a source
    rows = sources.withColumns({"__capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "__used": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    weights = sources.agg(F.sum("weight")).scalar()
    rows = rows.withColumn("__level", (F.lit(total) - c("__capped")) / (weights - c("__used")))
    fits = F.when(c("cap") >= c("weight") * c("__level"), c("__level"))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.min_by(fits, F.when(fits.isNotNull(), F.struct(c("cap") / c("weight"), "__source"))).alias("level")).first()
    return row.level if row.level is not None else float("inf") if row.n else 0.0  # inf: all are clamped


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row a source: __source, source_size, target, whole, cross and cut (what the fractional repetition takes).

    ``sized`` has __source, __key, __bucket, size."""
    totals = sized.groupBy("__source", "__bucket").agg(F.sum("size").alias("size"))
    totals = common.materialize(totals, "mix-buckets")
    rank = F.row_number().over(W.orderBy(F.col("__source") == "n", "__source")) - 1  # a row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1)
    sources = totals.groupBy("__source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    sources = common.materialize(sources.withColumn("cap", epochs * F.col("source_size")), "mix-sources")
    everything = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    level = water_level(sources, share * everything)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    plan = sources.select("__source", "source_size", target.alias("target"))
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    cum = F.sum("size").over(W.partitionBy("__source").orderBy("__bucket"))
    crossing = totals.withColumn("upto", cum).join(plan.select("__source", "rest"), "__source")
    crossing = crossing.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
    crossing = crossing.select("__source", "__bucket", (F.col("rest") - F.col("upto") + F.col("size")).alias("room"))
    inside = sized.join(crossing, ["__source", "__bucket"])
    one = W.partitionBy("__source").orderBy("__key")
    peers = F.sum("size").over(W.partitionBy("__source", "__key"))
    taken = inside.withColumns({"upto": F.sum("size").over(one), "peers": peers}).where(F.col("upto") - F.col("peers") / 2 <= F.col("room"))
    cuts = crossing.select("__source", F.col("__bucket").alias("cross")).join(taken.groupBy("__source").agg(F.max("__key").alias("cut")), "__source", "left")
    return common.materialize(plan.join(cuts, "__source", "left").drop("rest"), "mix-plan")


def repetitions() -> Column:
    """How often a row with the columns of _keys() and of the plan is taken."""
    extra = (F.col("__bucket") < F.col("cross")) | ((F.col("__bucket") == F.col("cross")) & (F.col("__key") <= F.col("cut")))
    return (F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).cast("long")


def size_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    sized = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.col("text"))
    return common.materialize(sized.withColumns(_keys(F.col("doc_id"), F.col("source"), F.col("text"), seed)).drop("text"), "mix-sized")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    plan = mixing_plan(size_documents(docs, seed), weights, share, epochs)
    rows = docs.select(F.struct("*").alias("__row")).withColumns(_keys(F.col("__row.doc_id"), F.col("__row.source"), F.col("__row.text"), seed))
    rows = rows.join(plan, "__source").withColumn("__times", repetitions()).where("__times > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")


def op4_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, repetitions, taken for every document."""
    sized = size_documents(common.table(spark, sf_dir, "documents"))
    rows = sized.join(mixing_plan(sized), "__source").withColumn("repetitions", repetitions())
    return rows.select("doc_id", "source", "size", "source_size", "target", "repetitions", (F.col("size") * F.col("repetitions")).alias("taken"))


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r
  FROM d GROUP BY source),
c AS (SELECT *, CASE r WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM s),
o AS (
  SELECT *, (coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS capped,
         (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open_w,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total
  FROM c),
l AS (SELECT min_by((total - capped) / open_w, cap / w) AS level FROM o WHERE cap >= w * ((total - capped) / open_w)),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * level) AS target FROM c, l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM t),
m AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.k) AS peers
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, (whole + CASE WHEN rest > 0 AND upto - peers / 2.0 <= rest THEN 1 ELSE 0 END)::BIGINT AS repetitions FROM m)
SELECT doc_id, source, size, source_size, target, repetitions, size * repetitions AS taken FROM x
"""
