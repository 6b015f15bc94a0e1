"""Running values over one long key in many tasks: chunks of rows in order, and what each chunk hands to the next.

A window over a key is one task, however long the key. Here rows are dealt by ranges of
key and order, so that each chunk is a stretch of rows in order and a long key has many;
windows run within (key, chunk). A chunk's total, in a form that composes, is one row,
and a window over these few rows gives each chunk what lies before it (or behind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.sources import scratch


#: Rows of a key up to which one task takes it whole.
CHUNK = 1_000_000


def is_long(rows: DataFrame, key: str, most: int | None = None) -> bool:
    """Whether a key has more rows than one task should take."""
    most = CHUNK if most is None else most
    return not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).isEmpty()


def bounds(rows: DataFrame, key: str, order: str, most: int | None = None) -> DataFrame | None:
    """Of every key with more rows than one task should take, values of ``order`` (column bounds) that cut them into stretches of about half as many; None where no key has.

    They are taken from a sample by hash, one row a key; where a stretch ends changes no result."""
    most = CHUNK if most is None else most
    own = F.when(F.pmod(F.xxhash64(order), F.lit(max(1, most // 512))) == 0, F.col(order))
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(own)).alias("x")).where(F.col("n") > most)
    pieces = F.ceil(F.col("n") * 2 / most)
    at = F.transform(F.sequence(F.lit(1).cast("long"), pieces - 1), lambda k: F.get("x", F.floor(k * F.size("x") / pieces).cast("int")))
    found = scratch.keep(found.select(key, F.filter(at, lambda x: x.isNotNull()).alias("bounds")), "bounds")
    return None if found.isEmpty() else found


def deal(rows: DataFrame, bounds: DataFrame | None, key: str, order: str) -> DataFrame:
    """``rows`` with a column chunk, the stretch that bounds() puts them in, and dealt to tasks by it; one a key where there are none. Windows over (key, chunk) need no other shuffle."""
    if bounds is None:
        return rows.withColumn("chunk", F.lit(0))
    at = F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda x: x <= F.col(order))))
    return rows.join(F.broadcast(bounds), key, "left").withColumn("chunk", at).drop("bounds").repartition(key, "chunk")


def cut(rows: DataFrame, split: bool, key: str, *order: str) -> DataFrame:
    """``rows`` with columns pos and chunk: pos has the order of ``order`` within the key, chunks are stretches of it; one a key unless ``split``.

    Rows alike in key and the first of ``order`` share a chunk. There are as many chunks as the session has shuffle
    partitions, at most. Those are written, since another sample would cut elsewhere."""
    if not split:
        return rows.withColumns({"pos": F.struct(*order), "chunk": F.lit(0)})
    dealt = rows.repartitionByRange(key, order[0]).sortWithinPartitions(key, *order).withColumn("pos", F.monotonically_increasing_id())
    return scratch.keep(dealt.withColumn("chunk", F.shiftright("pos", 33).cast("int")), "scan")  # the upper bits are the partition's


def within(key: str, last_first: bool = False) -> WindowSpec:
    return W.partitionBy(key, "chunk").orderBy(F.desc("pos") if last_first else "pos")


def up_to(key: str, last_first: bool = False) -> WindowSpec:
    return within(key, last_first).rowsBetween(W.unboundedPreceding, 0)


def earlier(key: str) -> WindowSpec:
    """Over totals of chunks: those before."""
    return W.partitionBy(key).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)


def later(key: str) -> WindowSpec:
    """Over totals of chunks: those behind, the nearest last."""
    return W.partitionBy(key).orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)


def carried(rows: DataFrame, key: str, columns: list[str], *order: str) -> DataFrame:
    """``rows`` with each of ``columns`` as last known (not NULL) in the order of ``order`` within the key, the row itself included.

    The last known value of a stretch composes, so a long key is cut into chunks like any other scan."""
    split = is_long(rows, key)
    dealt = cut(rows, split, key, *order)
    out = dealt.withColumns({c: F.last(c, True).over(up_to(key)) for c in columns})
    if split:
        ends = dealt.groupBy(key, "chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in columns])
        before = ends.select(key, "chunk", *[F.last(c, True).over(earlier(key)).alias(f"__{c}") for c in columns])
        out = out.join(before, [key, "chunk"]).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])
    return out.drop("pos", "chunk")
