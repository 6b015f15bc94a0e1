import numpy as np
import pytest
from pyspark.sql import functions as F
from sqlcheck import check

from quantloom.llm import common
from quantloom.llm import cover_tree as c


def cloud(seed, n, dim=16, spread=(0.02, 0.05, 0.2)):
    """Clusters within clusters, lone vectors and scaled copies."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=(n // 4, dim))]
    for s in spread:
        around = rng.normal(size=(max(1, n // 40), dim))
        out.append(around[rng.integers(0, len(around), n // 4)] + s * rng.normal(size=(n // 4, dim)))
    x = np.concatenate(out).astype(np.float32)
    x[-3:] = x[:3] * np.float32(2)
    return x[rng.permutation(len(x))]


def brute(x, threshold, copies=None):
    x = x.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return (link * (np.ones(len(x), int) if copies is None else copies)[None, :]).sum(axis=1), label
        label = new


@pytest.mark.parametrize("seed", range(4))
def test_levels_are_nested_separated_and_cover(seed):
    x = cloud(seed, 400)
    tree, order = c.CoverTree.build(x, np.ones(len(x), np.int64))
    assert sorted(order) == list(range(len(x))) and np.allclose(tree.unit, c.units(x)[order])
    d = np.sqrt(np.maximum(0, 2 - 2 * tree.unit @ tree.unit.T))
    assert (tree.lo[0], tree.hi[0]) == (0, len(x))
    for k in range(len(tree.center)):
        below = np.arange(tree.lo[k], tree.hi[k])
        assert tree.center[k] in below and d[tree.center[k], below].max() <= tree.radius[k] + 1e-7
        if tree.count[k]:
            kids = np.arange(tree.first[k], tree.first[k] + tree.count[k])
            assert tree.center[k] in tree.center[kids]  # nested
            assert np.concatenate([np.arange(tree.lo[m], tree.hi[m]) for m in kids]).tolist() == below.tolist()
            far = d[np.ix_(tree.center[kids], tree.center[kids])] + 9 * np.eye(len(kids))
            radius = 2.0 ** np.floor(np.log2(max(far.min(), 1e-9)))
            assert far.min() > radius * 0.999 or far.min() < c.LEAST_RADIUS  # separated by the level's radius or more
        else:
            assert len(below) == 1


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.98, 0.999])
@pytest.mark.parametrize("seed", range(3))
def test_traversal_finds_all_links(seed, threshold):
    x = cloud(seed, 600)
    copies = np.random.default_rng(seed).integers(1, 4, len(x))
    for cut in (None, len(x) // 3):
        parts = [np.arange(len(x))] if cut is None else [np.arange(cut), np.arange(cut, len(x))]
        built = [c.CoverTree.build(x[p], copies[p]) for p in parts]
        ids = np.concatenate([p[o] for p, (_, o) in zip(parts, built)])
        found = [c.traverse(built[0][0], None, threshold)] if cut is None else [c.traverse(built[0][0], built[1][0], threshold)]
        u = c.units(x)
        link = u @ u.T >= threshold
        np.fill_diagonal(link, False)
        if cut is not None:
            link[:cut, :cut] = link[cut:, cut:] = False
        want = (link * copies[None, :]).sum(axis=1)[ids]
        assert (found[0].totals() == want).all() and want.sum()
        groups = found[0].label
        i, j = np.nonzero(link[np.ix_(ids, ids)])
        assert (groups[i] == groups[j]).all()
        assert len(set(groups)) == len(set(brute_groups(link)))


def brute_groups(link):
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1))
        if (new == label).all():
            return label.tolist()
        label = new


def test_tight_groups_count_without_descent(monkeypatch):
    x = np.ones((500, 8)) + 1e-4 * np.random.default_rng(1).normal(size=(500, 8))
    tree, _ = c.CoverTree.build(x, np.ones(500, np.int64))
    monkeypatch.setattr(c, "cosine", lambda *a: pytest.fail("descended"))
    links = c.traverse(tree, None)
    assert set(links.totals()) == {499} and set(links.label) == {0}


def table_of(spark, x, labels, ids=None):
    rows = [(int(i), [float(v) for v in e], g) for i, e, g in zip(range(len(x)) if ids is None else ids, x, labels)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_join_over_many_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 150)
    x = cloud(9, 900)
    x = np.concatenate([x, x[:40], x[:40]])
    ids = np.random.default_rng(3).permutation(len(x)) * 7
    labels = [k % 3 if k < 500 else 0 for k in range(len(x))]
    got = {r.vec_id: r for r in c.join(table_of(spark, x, labels, ids), 0.95).collect()}
    for g in (0, 1, 2):
        own = [k for k in range(len(x)) if labels[k] == g]
        own.sort(key=lambda k: ids[k])
        links, label = brute(x[own], 0.95)
        for k, n, at in zip(own, links, label):
            r = got[ids[k]]
            assert (r.n_links, r.component_id, r.kept) == (n, ids[own[at]], at == own.index(k))
    assert max(r.n_links for r in got.values()) > 10 and any(not r.kept for r in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "b"), (3, [-0.0, 1.0], 1, None), (4, [0.0, 5.0], 1, None), (5, [1.0, 0.0], 2, None), (6, [1.0, 0.0], None, None), (7, None, 1, None), (8, [0.0, 0.0], 1, None),
        (9, [1.0, None], 1, None), (10, [nan, 1.0], 1, None), (11, [inf, 1.0], 1, None), (12, [], 1, None), (13, [1.0, 0.0, 0.0], 1, None), (None, [3.0, 0.0], 1, None), (None, [1.0, 1.0], 3, None), (1, [1.0, 0.0], 1, "a"),
        (20, [1e200, 1e200], 4, None), (21, [1e-200, 1e-200], 4, None), (22, [1e200, 1e190], 4, None), (0, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string").withColumn("copies", F.lit("x")).withColumn("block", F.lit(1))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in c.join(docs).collect()), key=repr)
    lone = [(k, 0, k, True) for k in (5, 6, 7, 8, 9, 10, 11, 12, 13, 22, 0)]
    want = [(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (None, 3, 1, False), (3, 1, 3, True), (4, 1, 3, False), (None, 0, None, True), (20, 1, 20, True), (21, 1, 20, False), *lone]
    assert got == sorted(want, key=repr)
    assert c.join(docs.limit(0)).count() == 0


def test_pairs_at_the_threshold(spark):
    a = [1.0, 0.0]
    close = [[0.98, float(np.sqrt(1 - 0.98**2) * f)] for f in (0.999999999, 1.000000001, 0.99, 1.01)]
    rows = spark.createDataFrame([(k, [a, v][s], k) for k, v in enumerate(close) for s in (0, 1)], "vec_id long, embedding array<double>, label int").withColumn("vec_id", F.monotonically_increasing_id())
    want = [np.dot(a, v) / np.linalg.norm(v) >= 0.98 for v in close]
    got = {(r.label, r.n_links) for r in c.join(rows).join(rows, "vec_id").collect()}
    assert got == {(k, int(w)) for k, w in enumerate(want)} and want == [True, False, True, False]


def test_op13_equals_sql(spark, sf):
    check(c.op13_cover_tree_embedding_dedup(spark, sf), c.OP13_SQL, sf)


def test_sql_over_clusters(spark):
    rows = table_of(spark, cloud(5, 300), [k % 2 for k in range(300)])
    assert c.join(rows).where("n_links > 0").count() > 20
    check(c.join(rows), c.OP13_SQL, embeddings=rows)


def test_whole_table_of_one_size_larger(spark):
    rows = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    assert c.join(rows, 0.3).agg(F.sum("n_links")).first()[0] > 1000  # structure that isn't there at 0.98
