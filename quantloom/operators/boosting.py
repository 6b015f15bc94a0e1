"""Boosted trees on histograms: gradients summed by node, feature and bin as one aggregate a level, splits chosen from the sums.

Rows are bins of features and are never gathered: a level's histogram has at most
2^depth x features x bins rows, which partial aggregation reaches within each task, and
the driver sees one row a node. Leaves are -G / (H + l2); what is missing has a bin of its
own and goes to the side where the gain is larger (to the one with more rows where no row
of the node misses the feature). Trees grow by levels; there is no early stopping.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.sources import scratch

#: Rounds after which each row's sum so far is written, so that plans stay short.
WRITE = 10


@dataclass
class Split:
    feature: int
    bin: int  # bins up to it go left
    missing_left: bool
    left: Split | float = 0.0
    right: Split | float = 0.0


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    trees: list[Split | float] = field(default_factory=list)


def edges_of(rows: DataFrame, features: list[str], bins: int = 64) -> list[list[float]]:
    """Where each feature's bins meet, from its quantiles: at most ``bins`` - 1 numbers a feature."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(_value(f), F.array(*map(F.lit, shares)), 10_000).alias(f) for f in features]).first()
    return [sorted(set(found[f] or [])) for f in features]


def _value(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def binned(rows: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """``rows`` with ``__bins``: for each feature the number of edges at or below its value, -1 where it is missing."""
    cut = [k for k, e in enumerate(edges) if e]
    rows = rows.withColumns({f"__x{k}": _value(features[k]) for k in cut})
    if cut:  # looks each value up by halving
        splits = [[-math.inf, *edges[k], math.inf] for k in cut]
        rows = Bucketizer(splitsArray=splits, inputCols=[f"__x{k}" for k in cut], outputCols=[f"__b{k}" for k in cut], handleInvalid="keep").transform(rows)
    bins = [F.when(_value(f).isNull(), -1).otherwise(F.col(f"__b{k}").cast("int") if edges[k] else F.lit(0)) for k, f in enumerate(features)]
    return rows.withColumn("__bins", F.array(*bins)).drop(*[f"__{c}{k}" for c in "xb" for k in cut])


def _goes_left(s: Split) -> Column:
    at = F.col("__bins")[s.feature]
    return (at <= s.bin) if s.missing_left else (at <= s.bin) & (at >= 0)


def _leaf(tree: Split | float) -> Column:
    """What a tree adds to a row."""
    return F.when(_goes_left(tree), _leaf(tree.left)).otherwise(_leaf(tree.right)) if isinstance(tree, Split) else F.lit(float(tree))


def _node(tree: Split | None, place: int = 1) -> Column:
    """The number of the open node that a row lies in (1 the root, 2 k and 2 k + 1 below k), NULL in a closed one; open nodes are None."""
    if tree is None:
        return F.lit(place)
    if not isinstance(tree, Split):
        return F.lit(None).cast("int")
    return F.when(_goes_left(tree), _node(tree.left, 2 * place)).otherwise(_node(tree.right, 2 * place + 1))


def _best(histogram: DataFrame, l2: float, least: int) -> DataFrame:
    """The best split of each node: from running sums over the bins of a feature, with what is missing on either side."""
    up = W.partitionBy("node", "feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("node", "feature")
    real = F.col("bin") >= 0
    h = histogram
    for c in ("g", "h", "n"):
        h = h.withColumns({f"l{c}": F.sum(F.when(real, F.col(c)).otherwise(0)).over(up), f"t{c}": F.sum(c).over(whole), f"m{c}": F.sum(F.when(real, 0).otherwise(F.col(c))).over(whole)})
    h = h.where(real).withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True))))
    h = h.where(F.col("missing_left") | (F.col("mn") > 0) | (2 * F.col("ln") < F.col("tn"))).where(~F.col("missing_left") | (F.col("mn") > 0) | (2 * F.col("ln") >= F.col("tn")))
    side = {c: F.col(f"l{c}") + F.when(F.col("missing_left"), F.col(f"m{c}")).otherwise(0) for c in ("g", "h", "n")}
    h = h.select("node", "feature", "bin", "missing_left", *[x.alias(f"l{c}") for c, x in side.items()], *[(F.col(f"t{c}") - x).alias(f"r{c}") for c, x in side.items()], "tg", "th")
    score = lambda g, w: F.col(g) * F.col(g) / (F.col(w) + l2)
    h = h.where(f"ln >= {least} AND rn >= {least}").withColumn("gain", score("lg", "lh") + score("rg", "rh") - score("tg", "th")).where("gain > 1e-12")
    first = F.max_by(F.struct("feature", "bin", "missing_left", "lg", "lh", "rg", "rh"), F.struct(F.round("gain", 9), -F.col("feature"), -F.col("bin"), "missing_left"))
    return h.groupBy("node").agg(first.alias("x")).select("node", "x.*")


def _grow(rows: DataFrame, depth: int, l2: float, rate: float, least: int) -> Split | float | None:
    """One tree over rows with __bins, g, h: a job a level, which returns a row a node; None where the rows can't be split."""
    nodes: dict[int, Split | float] = {}

    def tree(place: int, level: int):
        s = nodes.get(place)
        if not isinstance(s, Split):
            return s
        return Split(s.feature, s.bin, s.missing_left, tree(2 * place, level), tree(2 * place + 1, level))

    leaves: dict[int, float] = {}
    for level in range(depth):
        at = rows.withColumn("node", _node(tree(1, level))).where("node IS NOT NULL")
        cells = at.select("node", "g", "h", F.posexplode("__bins").alias("feature", "bin"))
        histogram = cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
        found = {r.node: r for r in _best(histogram, l2, least).collect()}  # at most 2^level rows
        for place in range(2**level, 2 ** (level + 1)):
            if place in found:
                r = found[place]
                nodes[place] = Split(r.feature, r.bin, r.missing_left)
                leaves[2 * place], leaves[2 * place + 1] = (-rate * g / (h + l2) for g, h in ((r.lg, r.lh), (r.rg, r.rh)))
            elif place in leaves:
                nodes[place] = leaves[place]
        if not found:
            break
    nodes.update({k: v for k, v in leaves.items() if k not in nodes})
    return tree(1, depth) if isinstance(nodes.get(1), Split) else None


def fit(rows: DataFrame, features: list[str], target: str = "target", weight: str | None = None, rounds: int = 300, depth: int = 4, rate: float = 0.06, l2: float = 1.0, least: int = 20, bins: int = 64, edges: list[list[float]] | None = None) -> Model:
    """A model of target 0 or 1; ``least`` rows a leaf. Rows without a target are left out; an error where they have one kind only."""
    rows = rows.where(F.col(target).isNotNull())
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    edges = edges_of(rows, features, bins) if edges is None else edges
    state = scratch.keep(binned(rows, features, edges).select("__bins", F.col(target).cast("double").alias("y"), w.alias("w")), "bins")
    total = state.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y")).first()
    if not total.w or not 0 < total.y < total.w:
        raise ValueError("the training rows have one kind of target only")
    share = total.y / total.w
    model = Model(features, edges, math.log(share / (1 - share)), rate)
    state, since = state.withColumn("f", F.lit(model.base)), 0
    for k in range(rounds):
        f = F.col("f")
        for tree in model.trees[since:]:
            f = f + _leaf(tree)
        if k - since == WRITE:
            state, since, f = scratch.keep(state.withColumn("f", f), "boosted"), k, F.col("f")
        p = 1 / (1 + F.exp(-f))
        found = _grow(state.select("__bins", "w", "y", p.alias("p")).select("__bins", (F.col("w") * (F.col("p") - F.col("y"))).alias("g"), (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h")), depth, l2, rate, least)
        if found is None:
            break
        model.trees.append(found)
    return model


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``probability`` of target 1; what is missing goes the way that it went in training. In plain columns: bins, then sums of leaves."""
    out = binned(rows, model.features, model.edges).withColumn("probability", F.lit(model.base))
    for a in range(0, len(model.trees), WRITE):
        more = F.col("probability")
        for tree in model.trees[a : a + WRITE]:
            more = more + _leaf(tree)
        out = out.withColumn("probability", more)
    return out.withColumn("probability", 1 / (1 + F.exp(-F.col("probability")))).drop("__bins")
