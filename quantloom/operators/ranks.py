"""Places in a global order, and measures that need them, without one task that sorts everything.

Rows are cut into ranges of their order (``scan``); a range numbers its own rows, and the
counts of the ranges, one row each, say how many lie before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.sources import scratch

from . import scan

_PLACE_BITS = 33  # of monotonically_increasing_id: below them the place within a partition


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their place from 1 in the order of ``order``, whose values must tell rows apart for the places to be the same in every run.

    Written once, since another sample would cut the ranges elsewhere; the window is over one row a range."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pos", F.monotonically_increasing_id())
    dealt = scratch.keep(dealt.withColumn("__range", F.shiftright("__pos", _PLACE_BITS)), "numbered")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.col("__pos").bitwiseAND((1 << _PLACE_BITS) - 1)
    return dealt.join(F.broadcast(before), "__range").withColumn(name, own + F.col("__before") + 1).drop("__range", "__pos", "__before")  # as many rows as shuffle partitions


def areas(scored: DataFrame, by: str) -> DataFrame:
    """by, yes, no, area: the area under the ROC curve of each ``by`` of ``scored`` (by, target 0 or 1, probability), as a sum of ranks in which equal scores share theirs.

    Rows without a score or target are left out; area is NULL where there is one kind of target only. Equal scores are
    counted before anything is sorted, so however many rows share one, they are one row; a ``by`` with more than
    scan.CHUNK different scores is cut into ranges, and the zeros below a range are a sum over ranges."""
    at = scored.where("probability IS NOT NULL AND target IS NOT NULL").groupBy(by, "probability")
    at = scratch.keep(at.agg(F.count_if(F.col("target") == 1).alias("yes"), F.count_if(F.col("target") == 0).alias("no")), "scores")
    dealt = scan.cut(at, scan.is_long(at, by), by, "probability")
    below = F.coalesce(F.sum("no").over(scan.within(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    exact = lambda x: x.cast("decimal(19,0)")
    won = exact(F.col("yes")) * exact(2 * F.col("below") + F.col("no"))  # twice the pairs won, ties half
    parts = dealt.withColumn("below", below).groupBy(by, "chunk").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.sum(won).alias("won"))
    earlier = F.coalesce(F.sum("no").over(scan.earlier(by)), F.lit(0))
    out = parts.withColumn("earlier", earlier).groupBy(by).agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.sum(F.col("won").cast("double") + 2.0 * F.col("yes") * F.col("earlier")).alias("won")
    )
    return out.select(by, "yes", "no", F.try_divide(F.col("won"), 2.0 * F.col("yes") * F.col("no")).alias("area"))
