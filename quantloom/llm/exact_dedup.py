"""Exact dedup with a log-structured merge index of digests, native DataFrame operations only.

Texts are equal when they are identical after every run of ASCII white space became
one space. The index holds (digest, smallest id, rows). Rows come in BATCHES by a hash;
each batch aggregates in the tasks' hash tables (the memtables) and is flushed as a run
sorted by digest, whose Parquet files have min/max values and a Bloom filter on the
digest, by which probe() skips files. After every FAN runs compaction merges them into
one and keeps the smallest identifier; a last one merges what is left. Digests of two
rows or more make a filter of bounded size that every row consults: only texts that it
can't exclude are read again and moved. A hit counts only after its bytes were compared
with those of the row that stays; where a digest turns out to stand for several texts,
its rows are grouped again by their whole bytes.

Nulls: a null text counts as empty; null ids come after all others, a group of null
ids alone has a null keep_id. Rows that repeat the smallest doc_id of their group:
the one with the smallest hash over all columns stays, of identical rows one.
No rows, no rows out. Columns of the input never clash with the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SPACES = r"[\x20\x09-\x0D]+"
MEMTABLES = 4
#: Batches of rows, each a run of the index, and runs that a compaction merges.
BATCHES = 4
FAN = 3


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of (digest, keep_id, n) under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.runs, self.written = spark, path, [], 0

    _SCHEMA = "digest binary, keep_id long, n long"
    _FILTERS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "compression": "zstd"}

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        out = rows.sortWithinPartitions(*by, "digest").write.options(**self._FILTERS)
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/{name}")

    def flush(self, entries: DataFrame, memtables: int = MEMTABLES, fan: int = FAN) -> None:
        """Add a batch (digest, doc_id): tasks aggregate their share of each memtable and flush it sorted; a FAN of runs is merged."""
        held = entries.withColumn("memtable", F.pmod(F.hash("doc_id"), F.lit(memtables)))
        held = held.groupBy("memtable", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        self._write(held, self._new("flushed"), "memtable")
        if len(self.runs) > fan:
            self.compact()

    def _new(self, kind: str) -> str:
        self.written += 1
        self.runs.append(f"{kind}-{self.written}")
        return self.runs[-1]

    def read(self) -> DataFrame:
        """The entries of all runs; after compact() one row a digest."""
        rows = [self.spark.read.schema(self._SCHEMA).parquet(f"{self.path}/{r}").select("digest", "keep_id", "n") for r in self.runs]
        out = self.spark.createDataFrame([], self._SCHEMA) if not rows else rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def compact(self) -> None:
        """Merge all runs into one sorted run that keeps the smallest identifier of each digest; one run alone stays."""
        if len(self.runs) < 2:
            return
        old, merged = self.runs, self.read().groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        self.runs = []
        self._write(merged, self._new("merged"))
        for r in old:
            common.drop_path(self.spark, f"{self.path}/{r}")

    def probe(self, digests: list[bytes]) -> DataFrame:
        """Entries of a few digests: files whose filters exclude all of them aren't read."""
        return self.read().where(F.col("digest").isin(digests))


def grouped(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> tuple[DataFrame, DataFrame]:
    """entries (doc_id, row, sha, digest) of all rows and groups (digest, keep_id, n) of equal texts.

    A digest of entries identifies one text: byte verification has been done."""
    spark = docs.sparkSession
    base = docs.select("doc_id", common.row_hash(docs).alias("row"), normalized(F.col("text")).alias("norm"))
    base = base.withColumns({"sha": F.sha2("norm", 256)}).withColumn("digest", digest(F.col("norm")))
    entries = common.materialize(base.drop("norm"), "dedup-entries")
    index = DigestIndex(spark, common.scratch_path(spark, "dedup-index"))
    batch = F.pmod(F.xxhash64("doc_id", "row"), F.lit(BATCHES))
    for k in range(BATCHES):
        index.flush(entries.where(batch == k))
    index.compact()
    shared = index.read().where("n > 1").select(F.col("digest").alias("of"), "keep_id")

    maybe = common.KeyFilter(shared, "of", name="dedup-filter").split(base, F.col("digest"))
    texts = common.materialize(maybe.where("__maybe").select(base.columns), "dedup-texts")
    # Joined by digest and id, so that a large group's rows go to many tasks; then one join that Spark can split.
    hits = texts.join(shared, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = common.materialize(hits.groupBy("digest").agg(F.min("norm").alias("stays")), "dedup-stays")
    differ = common.materialize(texts.join(stays, "digest").where("norm != stays").select("digest"), "dedup-differ")
    mixed = common.materialize(differ.distinct(), "dedup-mixed")

    if mixed.isEmpty():  # as always with whole SHA-256 digests
        return entries, index.read()
    exact = texts.join(mixed, "digest", "left_semi").withColumn("digest", F.concat("digest", F.encode("norm", "UTF-8")))
    again = exact.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = index.read().join(mixed, "digest", "left_anti").unionByName(again)
    return entries.join(mixed, "digest", "left_anti").unionByName(exact.select(entries.columns)), groups


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """Every row's doc_id, row (hash), sha, keep_id, group_size, kept."""
    entries, groups = grouped(docs, digest)
    rows = entries.join(groups.where("n > 1"), "digest", "left")
    rows = rows.select("doc_id", "row", "sha", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    lead = groups.where("n > 1").select(F.col("digest").alias("of"), F.col("keep_id").alias("lead"))
    ties = entries.join(lead, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("lead"))).groupBy("digest").count().where("count > 1").select("digest")
    ties = common.materialize(ties, "dedup-ties").withColumn("tied", F.lit(True))
    flagged = rows.join(ties, "digest", "left").withColumn("tied", F.coalesce("tied", F.lit(False)) & first)
    plain = flagged.where("NOT tied").withColumn("kept", first)
    place = F.row_number().over(W.partitionBy("digest").orderBy("row"))
    return plain.unionByName(flagged.where("tied").withColumn("kept", place == 1)).drop("digest", "tied")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return common.keep_rows(docs, dedup(docs), "dedup-marks")


def op5_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    out = dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = min(doc_id) OVER g, TRUE) AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""
