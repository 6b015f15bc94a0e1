import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm import common
from quantloom.llm import ngram_join as g


def norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", (t or "").lower()).strip(" ")


def brute_classes(rows, threshold=0.8, degrees=False):
    """Class ids by comparing all pairs of texts that share a shingle."""
    texts = [norm(t) for _, t in rows]
    sets = [g.shingles(t) for t in texts]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at, near = {}, [set() for _ in rows]
    for i, s in enumerate(sets):
        seen = set()
        for x in s:
            seen.update(at.get(x, ()))
            at.setdefault(x, []).append(i)
        for j in seen:
            common_ = len(s & sets[j])
            if common_ >= threshold * (len(s) + len(sets[j]) - common_) - 1e-9:
                parent[find(i)] = find(j)
                if texts[i] != texts[j]:
                    near[i].add(j)
                    near[j].add(i)
    empty = [i for i, t in enumerate(texts) if not t]
    for i in empty[1:]:
        parent[find(i)] = find(empty[0])
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    if degrees:
        return {texts[i]: len({texts[j] for j in near[i]}) for i in range(len(rows)) if near[i]}
    return sorted((repr(d), repr(min((x for x in ids[find(i)] if x is not None), default=None)), len(ids[find(i)])) for i, (d, _) in enumerate(rows))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "é", "ccc", "d"]), max_size=12), max_size=6))
def test_shingle_hashes_tell_sets_apart(docs):
    texts = [" ".join(w) for w in docs]
    raws = [t.encode() for t in texts]
    hashes, count = g.shingle_hashes(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws]).astype(np.int64))
    got = np.split(hashes, np.cumsum(count)[:-1]) if len(count) else []
    names = {}
    for t, h in zip(texts, got):
        assert len(set(h.tolist())) == len(g.shingles(t))
        w = t.split(" ") if t else []
        own = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        for s, x in zip(own, h.tolist()):
            assert names.setdefault(s, x) == x
    assert len(set(names.values())) == len(names)


def test_long_words_pass_the_window():
    raw = np.frombuffer(b"a" * 100 + b" bc", np.uint8)
    s, e = np.array([0, 101]), np.array([100, 103])
    assert (g.word_hashes(raw, s, e, 8) == g.word_hashes(raw, s, e)).all()


def test_minhash_values_estimate_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = base[:1800], base[200:]
    sig = g.minhashes(np.concatenate([a, b]), np.array([1800, 1800]), chunk=700)
    assert np.mean(sig[0] == sig[1]) == pytest.approx(0.8, abs=0.12)


def test_pruning_rule():
    least = g.fewest_equal(0.8, 1e-4)
    for n, m in zip(range(g.STEP, g.HASHES + 1, g.STEP), least):
        grid = (np.arange(200_000) + 0.5) / 200_000
        for k, low in ((m, False), (m - 1, True)):
            d = k * np.log(grid) + (n - k) * np.log(1 - grid)
            d = np.exp(d - d.max())
            assert (d[grid >= 0.8].sum() / d.sum() < 1e-4) == low
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, (3, g.HASHES), dtype=np.uint32)
    y = x.copy()
    y[1, rng.random(g.HASHES) < 0.5] = 7
    y[2] = 9
    assert g.survivors(x, y, least).tolist() == [0]


def test_op7_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    got = g.op7_bayesian_jaccard_join(spark, sf).collect()
    assert sorted((repr(r.doc_id), repr(r.class_id), r.members) for r in got) == brute_classes(rows)
    texts = {d: norm(t) for d, t in rows}
    assert {texts[r.doc_id]: r.links for r in got if r.links} == brute_classes(rows, degrees=True)


def variants(seed, n, swaps):
    """An original and copies that each differ from it in a few words, so that two copies differ twice as much."""
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(200)]
    out = [" ".join(base)]
    for k in range(n):
        own = list(base)
        for i in rng.choice(np.arange(5, 195), swaps, replace=False):
            own[i] = f"s{seed}k{k}i{i}"
        out.append(" ".join(own))
    return out


def test_groups_around_an_original_stay_whole(spark):
    texts = variants(1, 60, 4) + variants(2, 40, 4) + variants(3, 30, 14)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, degrees, _ = g.join(df)
    classes = rows.join(df.select("doc_id", "text"), "doc_id").groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = sorted((r.n for r in classes), reverse=True)
    want = {}
    for d, c, _ in brute_classes(list(enumerate(texts))):
        want[c] = want.get(c, 0) + 1
    assert sizes == sorted(want.values(), reverse=True)
    got = {texts[r.doc_id]: r.links for r in rows.join(degrees, "key").collect()}
    assert got == brute_classes(list(enumerate(texts)), degrees=True)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.9])
def test_links_dont_depend_on_how_many_share_a_bucket(spark, threshold):
    """Groups of 2 to 40 variants that few words tell apart, at several thresholds: exactly the links of all pairs."""
    texts = [t for k, n in enumerate((1, 6, 7, 8, 9, 20, 39)) for t in variants(20 + k, n, 6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, degrees, _ = g.join(df, threshold)
    got = {texts[r.doc_id]: r.links for r in rows.join(degrees, "key").collect()}
    want = brute_classes(list(enumerate(texts)), threshold, degrees=True)
    # The estimate may drop a pair at the very threshold, as the tolerance says.
    assert set(got) <= set(want) and sum(got.values()) >= 0.99 * sum(want.values()) and all(got[t] <= want[t] for t in got)


def test_bands_follow_from_the_threshold():
    assert g.bands(0.8) == (25, 5)
    for t in (0.05 + 0.05 * k for k in range(2, 19)):
        n, rows = g.bands(t)
        assert n * rows <= g.HASHES and 1 - (1 - t**rows) ** n >= g.RECALL
    with pytest.raises(ValueError, match="too few"):
        g.bands(0.01)


def test_shared_shingles_against_sets():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(1, 40))) for _ in range(30)] + ["a b c", "a b c d"]
    a, b = np.triu_indices(len(texts), 1)
    both, sizes = g.shared_shingles(texts, a, b, columns=7)
    sets = [g.shingles(t) for t in texts]
    assert sizes.tolist() == [len(s) for s in sets] and both.tolist() == [len(sets[i] & sets[j]) for i, j in zip(a, b)]


def test_cells_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(g, "BLOCK", 4)
    texts = variants(4, 25, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, degrees, classes = g.join(df)
    assert [r.members for r in classes.collect()] == [26]
    got = {texts[r.doc_id]: r.links for r in rows.join(degrees, "key").collect()}
    assert got == brute_classes(list(enumerate(texts)), degrees=True)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found, _, classes = g.join(odd)
    out = found.join(classes, "group", "left").select("doc_id", F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("c"), F.coalesce("members", F.lit(1)).alias("m"))
    want = brute_classes(rows)
    assert sorted((repr(r.doc_id), repr(r.c), r.m) for r in out.collect()) == want
    kept = g.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({c for _, c, _ in want} )
    assert g.keep_one(none).columns == none.columns and g.keep_one(none).count() == 0
