"""Shared helpers of the llm operators: scratch tables, table reading, row choice."""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FALLBACK = "/tmp/checkpoints"
_WRITTEN: dict[int, tuple[str, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set and Spark is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return _LOCAL_FALLBACK
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that no later plan reads."""
    with contextlib.suppress(Exception):  # at exit the JVM may be gone already
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression=codec, **(options or {})).parquet(path)
    return _written(df.sparkSession.read.schema(df.schema).parquet(path), path)


def materialize_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialize(), in buckets by ``key``: later joins on it don't move these rows."""
    spark = df.sparkSession
    path, table_name = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table_name)
    return _written(spark.table(table_name), path, table_name)


def _written(df: DataFrame, path: str, table_name: str | None = None) -> DataFrame:
    """``df``, of which drop() knows where it was written as long as it lives."""
    _WRITTEN[id(df)] = path, table_name
    weakref.finalize(df, _WRITTEN.pop, id(df), None)
    return df


def drop(*tables: DataFrame) -> None:
    """Remove tables of materialize() or materialize_bucketed() that no later plan reads."""
    for df in tables:
        spark, (path, table_name) = df.sparkSession, _WRITTEN.pop(id(df), (None, None))
        if table_name:
            spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        if path:
            drop_path(spark, path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_order(col: str = "doc_id") -> list[Column]:
    """Ascending order of ids in which null ids come last."""
    return [F.col(col).isNull(), F.col(col)]


def row_hash(docs: DataFrame) -> Column:
    """A hash over all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_2, name_3, ... that no column of ``df`` has in any case."""
    taken, k = {c.lower() for c in df.columns}, 1
    while (found := name if k == 1 else f"{name}_{k}").lower() in taken:
        k += 1
    return found


#: Bits of a key filter for each key, and its least and most bits (8 MB, which tasks get as a broadcast).
FILTER_BITS_A_KEY, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 26


class KeyFilter:
    """Which keys can be among ``keys``: a Bloom filter of one hash as rows of bitmaps, at most FILTER_MOST bits in all.

    Beyond FILTER_MOST / FILTER_BITS_A_KEY keys it excludes less, never wrongly."""

    def __init__(self, keys: DataFrame, *by: str, name: str = "filter"):
        n = keys.count()
        self.bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (max(1, n * FILTER_BITS_A_KEY) - 1).bit_length()))
        at = self._place(*map(F.col, by))
        rows = keys.select(F.bitmap_bucket_number(at).alias("__bucket"), F.bitmap_bit_position(at).alias("__bit"))
        self.rows = materialize(rows.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map")), name)

    def _place(self, *by: Column) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(self.bits)) + 1

    def split(self, rows: DataFrame, *by: Column) -> DataFrame:
        """``rows`` with a column __maybe: false only where the key isn't among the keys."""
        at = self._place(*by)
        byte = F.conv(F.hex(F.substring("__map", (F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = rows.withColumn("__at", F.bitmap_bucket_number(at)).join(F.broadcast(self.rows), F.col("__at") == F.col("__bucket"), "left")
        return held.withColumn("__maybe", F.coalesce(F.getbit(byte, F.bitmap_bit_position(at) % 8) == 1, F.lit(False))).drop("__at", "__bucket", "__map")


def keep_rows(docs: DataFrame, decided: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, row as of row_hash(), kept; a row for each row) keeps.

    Rows of one id and hash are alike in every column; one of them stays if any is kept. Only rows that a filter
    can't tell from those that go are moved."""
    marks = decided.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__hash")).agg(F.count(F.lit(1)).alias("__n"), F.max("kept").alias("__any"))
    marks = materialize(marks.where("NOT __any OR __n > 1"), name)
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), row_hash(docs).alias("__hash"))
    packed = KeyFilter(marks, "__id", "__hash", name=f"{name}-filter").split(packed, F.col("__id"), F.col("__hash"))
    sure, maybe = packed.where("NOT __maybe"), packed.where("__maybe")
    match = [maybe[k].eqNullSafe(marks[k]) for k in ("__id", "__hash")]
    once = maybe.join(marks, match, "left_anti")
    several = maybe.join(marks.where("__any"), match, "left_semi").dropDuplicates(["__id", "__hash"])
    return sure.unionByName(once).unionByName(several).select("__row.*")
