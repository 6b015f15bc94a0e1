"""Tables written to the shared folder: they cut a plan short, and a lost executor loses none of them."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK = "/tmp/checkpoints"


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where it is unset and Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return _LOCAL_FALLBACK
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone already
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def later(spark: SparkSession, path: str) -> None:
    """Have a path go when the driver ends."""
    atexit.register(drop, spark, path)


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written under a path of its own, which goes when the driver ends, and read back.

    Each call reads the inputs anew, unlike a persisted frame, which answers for files that have changed since."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    later(spark, path)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)
