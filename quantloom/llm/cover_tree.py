"""Near duplicates among embeddings of one label by cover trees and dual traversal.

Vectors of one direction and another are as far apart as their chord, sqrt(2 - 2 cos).
Vectors that are identical count as one with copies. A label's vectors are dealt into
blocks of a bounded size: a label larger than a block is first cut into rings, whose
width is the threshold's chord, by the distance from one of its vectors, so that links
join a ring with itself or the next alone; a ring larger than a block is dealt by hash.

Each block becomes a cover tree: levels of radius 1, 1/2, 1/4 and so on, each level
holding the points of the one above (nested), more than its radius apart from each
other, with every point within it; a node knows the exact distance of the farthest point
below it (covering radius). Two blocks are compared if their roots and covering radii
allow a link, in one task, by descending both trees at once: a pair of nodes is dropped
if its distance less both radii is above the threshold's, counts whole without descent
if even its farthest points are linked, and else its children are compared with one
matrix product. Points are decided by their cosine in double precision. Pairs never
leave the task: it hands on how many links each vector has, and for each group that they
join edges to one of its vectors. Components are then found over all blocks.

On vectors without any structure, whose distances are nearly all alike, the bounds drop
few pairs of blocks, and time grows with the square of a label, as an exact answer asks.

Nulls: a vector that is null, empty, zero or holds null or non-finite components, or whose
label is null, links with nothing, nor do vectors of different lengths. A null vec_id is
never a component's id while another is there; a component of null ids alone has a null
id, and its rows are kept. Rows that repeat are linked with each other. No rows, no rows
out. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import components

THRESHOLD = 0.98
#: Vectors and bytes of a block.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Below this radius no further level is made.
LEAST_RADIUS = 1e-6
#: Entries of one matrix product, and how far rounding may move a cosine or a distance.
PRODUCT, SLACK = 1 << 21, 1e-7
GROUP = ("label", "size")


def chord(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 of rows that aren't zero."""
    x = scaled(raw)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that no square is too large or small; exact."""
    x = raw.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two equally long tables of scaled rows, summed without a matrix product."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


class CoverTree:
    """Nodes of nested levels over the rows of ``raw``, which lie in the order of a descent: a node's points are lo to hi."""

    def __init__(self, raw: np.ndarray, nodes: np.ndarray, radius: np.ndarray, copies: np.ndarray):
        self.raw, self.nodes, self.radius, self.copies = scaled(raw), nodes, radius, copies
        self.unit = units(raw)
        self.center, self.lo, self.hi, self.first, self.count = nodes
        self.sums = np.append(0, np.cumsum(copies))

    @classmethod
    def build(cls, raw: np.ndarray, copies: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree, and the order in which it has the rows."""
        x, n = units(raw), len(raw)
        away = lambda c: np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x[c])))
        near, at, below = away(0), np.zeros(n, np.int64), [[] for _ in range(n)]
        near[0], level, radius, placed = 0.0, 0, 1.0, 1
        chosen = np.zeros(n, bool)
        chosen[0] = True
        while placed < n and radius > LEAST_RADIUS:
            above = at.copy()  # who covers each point in the level above
            while near[c := int(near.argmax())] > radius:
                d = away(c)
                d[c] = -1.0
                closer = d < near
                near[closer], at[closer] = np.maximum(d[closer], 0.0), c
                below[above[c]].append((level, c))
                chosen[c] = True
                placed += 1
            level, radius = level + 1, radius / 2
        for c in np.flatnonzero(~chosen).tolist():
            below[at[c]].append((level, c))

        found, first, count = [(0, 0)], [0], [0]
        for k, (c, done) in enumerate(found):  # grows meanwhile
            to = done
            while to < len(below[c]) and below[c][to][0] == below[c][done][0]:
                to += 1
            if to > done:
                children = [(c, to), *((y, 0) for _, y in below[c][done:to])]
                first[k], count[k] = len(found), len(children)
                found += children
                first += [0] * len(children)
                count += [0] * len(children)
        size = np.ones(len(found), np.int64)
        for k in range(len(found) - 1, -1, -1):
            if count[k]:
                size[k] = size[first[k] : first[k] + count[k]].sum()
        lo, order = np.zeros(len(found), np.int64), np.empty(n, np.int64)
        for k, (c, _) in enumerate(found):
            if count[k]:
                own = slice(first[k], first[k] + count[k])
                lo[own] = lo[k] + np.append(0, np.cumsum(size[own])[:-1])
            else:
                order[lo[k]] = c
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        center = place[[c for c, _ in found]]
        sorted_x, far = x[order], np.zeros(len(found))
        for k in np.flatnonzero(count):
            far[k] = chord(float((sorted_x[lo[k] : lo[k] + size[k]] @ sorted_x[center[k]]).min()))
        nodes = np.array([center, lo, lo + size, first, count], np.int32)
        return cls(raw[order], nodes, far, copies[order]), order


class Links:
    """Counts of links of positions, and the groups that they join."""

    def __init__(self, n: int):
        self.count, self.label = np.zeros(n + 1, np.int64), np.arange(n)
        self.steps = np.zeros(n + 1, np.int64)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (new := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = new

    def totals(self) -> np.ndarray:
        return (self.count + np.cumsum(self.steps))[:-1]


def traverse(x: CoverTree, y: CoverTree | None, threshold: float = THRESHOLD) -> Links:
    """Links of all pairs of a point of ``x`` and one of ``y`` (behind those of x), or of two points of ``x``."""
    own, other = y is None, x if y is None else y
    shift = 0 if own else len(x.raw)
    out, most = Links(len(x.raw) + (0 if own else len(other.raw))), chord(threshold)

    def whole(k: int, m: int) -> None:
        """All points below two nodes are linked."""
        a, b = slice(x.lo[k], x.hi[k]), slice(other.lo[m] + shift, other.hi[m] + shift)
        if own and k == m:
            out.steps[a.start] += x.sums[a.stop] - x.sums[a.start]
            out.steps[a.stop] -= x.sums[a.stop] - x.sums[a.start]
            out.count[a] -= x.copies[a]
        else:
            for s, w in ((a, other.sums[other.hi[m]] - other.sums[other.lo[m]]), (b, x.sums[x.hi[k]] - x.sums[x.lo[k]])):
                out.steps[s.start] += w
                out.steps[s.stop] -= w
        every = np.r_[a, b]
        out.join(every, np.full(len(every), a.start))

    def near(i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> None:
        """Points i and j that may be linked."""
        if not len(i):
            return
        good = cos >= threshold
        close = np.flatnonzero(np.abs(cos - threshold) <= SLACK)
        good[close] = cosine(x.raw[i[close]], other.raw[j[close]]) >= threshold
        i, j = i[good], j[good]
        np.add.at(out.count, i, other.copies[j])
        np.add.at(out.count, j + shift, x.copies[i])
        out.join(i, j + shift)

    def compare(ks: np.ndarray, ms: np.ndarray, same: bool) -> list[tuple[int, int]]:
        later = []
        for at in range(0, len(ks), step := max(1, PRODUCT // len(ms))):
            part = ks[at : at + step]
            cos = x.unit[x.center[part]] @ other.unit[other.center[ms]].T
            reach = np.minimum(2.0, most + SLACK + x.radius[part][:, None] + other.radius[ms][None, :])
            i, j = np.nonzero(cos >= 1 - reach * reach / 2 - SLACK)
            if same:  # each pair once
                i, j = i[i + at <= j], j[i + at <= j]
            k, m, c = part[i], ms[j], cos[i, j]
            points = (x.count[k] == 0) & (other.count[m] == 0)
            two = points & (k != m) if same else points
            near(x.center[k[two]], other.center[m[two]], c[two])
            k, m, c = k[~points], m[~points], c[~points]
            wide = np.sqrt(np.maximum(0.0, 2 - 2 * c)) + x.radius[k] + other.radius[m]
            if own:
                wide[k == m] = 2 * x.radius[k[k == m]]
            for a, b in zip(k[wide <= most - SLACK].tolist(), m[wide <= most - SLACK].tolist()):
                whole(a, b)
            later += zip(k[wide > most - SLACK].tolist(), m[wide > most - SLACK].tolist())
        return later

    todo = compare(np.array([0]), np.array([0]), own)
    while todo:
        k, m = todo.pop()
        ks = np.arange(x.first[k], x.first[k] + x.count[k]) if x.count[k] else np.array([k])
        ms = np.arange(other.first[m], other.first[m] + other.count[m]) if other.count[m] else np.array([m])
        todo += compare(ks, ms, own and k == m)
    return out


def vector_key(label: Column, embedding: Column) -> Column:
    """128 bits that name a label's vector."""
    same = F.transform(embedding, lambda v: v + F.lit(0.0))  # 0.0 for -0.0
    half = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), label, same)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding, key of every row; a null key where it can't be linked."""
    v = F.col("embedding")
    fit = F.col("label").isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)  # NaN isn't below
    return rows.select("vec_id", "label", "embedding", F.when(fit, vector_key(F.col("label"), v)).alias("key"))


def dealt(vectors: DataFrame, threshold: float) -> DataFrame:
    """``vectors`` with their block: label, size, ring and part."""
    wide = 4 if "array<float>" in vectors.schema["embedding"].dataType.simpleString() else 8
    parts = lambda n: F.ceil(F.greatest(n / BLOCK, n * F.col("size") * wide / BLOCK_BYTES))
    count = vectors.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).where(parts(F.col("n")) > 1)
    pivots = common.materialize(vectors.join(count.select("first"), F.col("key") == F.col("first")).select(*GROUP, F.col("embedding").alias("pivot")), "cover-pivots")

    @F.pandas_udf("long")
    def ring(v, p):
        import pandas as pd

        out = pd.Series(0, index=v.index, dtype="int64")
        for dim, at in v.groupby(v.map(len)).groups.items():
            if (has := p[at].notna()).any():
                a, b = (units(np.stack(s[at][has].tolist())) for s in (v, p))
                out[at[has]] = (np.sqrt(np.maximum(0.0, 2 - 2 * (a * b).sum(axis=1))) // (chord(threshold) * (1 + SLACK) + SLACK)).astype(np.int64)
        return out

    ringed = common.materialize(vectors.join(pivots, list(GROUP), "left").withColumn("ring", ring("embedding", "pivot")).drop("pivot"), "cover-rings")
    sizes = ringed.groupBy(*GROUP, "ring").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", parts(F.col("n"))).where("parts > 1").drop("n")
    out = ringed.join(common.materialize(sizes, "cover-sizes"), [*GROUP, "ring"], "left")
    part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))
    return out.select(F.struct(*GROUP, "ring", part.alias("part")).alias("block"), "key", "embedding", "copies")


def plant(blocks: DataFrame) -> DataFrame:
    """A row a block: its tree as bytes, its root's direction and covering radius."""
    kind = "<f4" if "array<float>" in blocks.schema["embedding"].dataType.simpleString() else "<f8"
    packed = blocks.groupBy("block").agg(F.collect_list(F.struct("key", "embedding", "copies")).alias("rows"))  # BLOCK on average

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k, rows in enumerate(b.column("rows")):
                rows = rows.as_py()
                tree, order = CoverTree.build(np.array([r["embedding"] for r in rows], kind), np.array([r["copies"] for r in rows], np.int64))
                keys, raw = b"".join(rows[i]["key"] for i in order), np.array([rows[i]["embedding"] for i in order], kind).tobytes()
                one = [pa.array([x], t) for x, t in zip((keys, raw, tree.nodes.tobytes(), tree.radius.tobytes(), tree.copies.tobytes(), tree.unit[tree.center[0]].tolist(), float(tree.radius[0])), kinds)]
                yield pa.RecordBatch.from_arrays([b.column("block").slice(k, 1), *one], ["block", "keys", "raw", "nodes", "radii", "copies", "root", "radius"])

    import pyarrow as pa

    kinds = [pa.binary()] * 5 + [pa.list_(pa.float64()), pa.float64()]
    schema = f"block {packed.schema['block'].dataType.simpleString()}, keys binary, raw binary, nodes binary, radii binary, copies binary, root array<double>, radius double"
    return packed.mapInArrow(run, schema)


TREE = ("keys", "raw", "nodes", "radii", "copies")


def compared(trees: DataFrame, kind: str, threshold: float) -> DataFrame:
    """a, b of joining edges, and a, n (b null) of link counts, over all pairs of blocks that may hold a link."""
    side = lambda c: trees.select(*[F.col(f"block.{g}").alias(f"{c}_{g}") for g in GROUP], F.col("block.ring").alias(f"{c}_ring"), F.col("block").alias(c), F.col("root").alias(f"{c}_root"), F.col("radius").alias(f"{c}_radius"))
    left, right = side("x").withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))), side("y")
    met = left.join(right, [left[f"x_{g}"] == right[f"y_{g}"] for g in GROUP] + [left["x_ring"] + left["step"] == right["y_ring"]])
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("x_root", "y_root", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
    met = met.where((F.col("step") == 1) | (F.col("x.part") <= F.col("y.part"))).where(apart <= chord(threshold) + F.col("x_radius") + F.col("y_radius") + 2 * SLACK)
    pairs = common.materialize(met.select("x", "y"), "cover-pairs")
    packed = lambda c: trees.select(F.col("block").alias(c), F.struct(*TREE).alias(f"{c}_tree"))
    one = pairs.join(packed("x"), "x")
    alone = one.where("x = y").select("x_tree", F.lit(None).cast(one.schema["x_tree"].dataType).alias("y_tree"))
    both = one.where("x != y").join(packed("y"), "y").select("x_tree", "y_tree")

    def load(t: dict) -> tuple[CoverTree, list[bytes]]:
        copies = np.frombuffer(t["copies"], np.int64)
        keys = [t["keys"][16 * k : 16 * k + 16] for k in range(len(copies))]
        return CoverTree(np.frombuffer(t["raw"], kind).reshape(len(copies), -1), np.frombuffer(t["nodes"], np.int32).reshape(5, -1), np.frombuffer(t["radii"], np.float64), copies), keys

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for x, y in zip(b.column("x_tree"), b.column("y_tree")):
                left, keys = load(x.as_py())
                right = None
                if y.is_valid:
                    right, more = load(y.as_py())
                    keys = keys + more
                links = traverse(left, right, threshold)
                total = links.totals()
                n, e = np.flatnonzero(total), np.flatnonzero(links.label != np.arange(len(links.label)))
                a = [keys[k] for k in n] + [keys[k] for k in e]
                other = [None] * len(n) + [keys[k] for k in links.label[e]]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(other, pa.binary()), pa.array(total[n].tolist() + [None] * len(e), pa.int64())], ["a", "b", "n"])

    return alone.unionByName(both).mapInArrow(run, "a binary, b binary, n long")


def join(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links (other rows whose vector has a cosine of ``threshold`` or more), component_id and kept of every row; 0 < threshold < 1."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    rows = keyed(rows)
    vectors = rows.where("key IS NOT NULL").groupBy("key", "label", F.transform("embedding", lambda v: v + F.lit(0.0)).cast(rows.schema["embedding"].dataType).alias("embedding")).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    vectors = common.materialize(vectors.withColumn("size", F.size("embedding")), "cover-vectors")
    kind = "<f4" if "array<float>" in rows.schema["embedding"].dataType.simpleString() else "<f8"
    trees = common.materialize(plant(dealt(vectors.drop("least"), threshold)), "cover-trees")
    within = common.materialize(compared(trees, kind, threshold), "cover-within")
    common.drop(trees)
    labels = components(within.where("b IS NOT NULL").select("a", "b"), "cover-final")
    degrees = within.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))

    grouped = vectors.select("key", "copies", "least").join(labels.withColumnRenamed("label", "group"), "key", "left").withColumn("group", F.coalesce("group", "key"))
    grouped = common.materialize(grouped.join(degrees, "key", "left"), "cover-grouped")
    classes = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    told = grouped.join(classes, "group").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = rows.where("key IS NOT NULL").select("vec_id", "key").join(told, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_cover_tree_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, linked within its label at a cosine of 0.98 or more."""
    return join(common.table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
