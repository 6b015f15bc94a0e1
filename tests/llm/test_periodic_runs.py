import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import common
from quantloom.llm import periodic_runs as p


def brute_next(t):
    n = len(t)
    after = [next((j for j in range(i + 1, n) if t[j:] < t[i:]), n) for i in range(n)]

    def shared(i, j):
        k = 0
        while j + k < n and t[i + k] == t[j + k]:
            k += 1
        return k

    return after, [shared(i, j) for i, j in enumerate(after)]


def brute_runs(t, least=24, times=3):
    """From equal neighbours at each distance, smallest periods by trying them all."""
    n, out = len(t), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(all(t[k] == t[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


repetitive = st.recursive(st.lists(st.integers(0, 3), min_size=1, max_size=6), lambda x: st.tuples(x, st.integers(1, 5)).map(lambda y: y[0] * y[1]) | st.tuples(x, x).map(lambda y: y[0] + y[1]), max_leaves=8).map(lambda t: t[:400])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60) | repetitive)
def test_lyndon_arrays_and_what_suffixes_share(t):
    assert p.lyndon(t) == brute_next(t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=80) | repetitive, st.sampled_from([(24, 3), (2, 2), (5, 2), (9, 4)]))
def test_runs(t, wanted):
    assert p.runs_of(np.array(t, np.int64), *wanted) == brute_runs(t, *wanted)


class Counted(list):
    looks = 0

    def __getitem__(self, k):
        Counted.looks += 1
        return list.__getitem__(self, k)


@pytest.mark.parametrize("kind", ["one", "fibonacci", "blocks", "thue", "period", "random", "nested"])
def test_each_symbol_is_looked_at_a_few_times(kind):
    n = 6000
    fib = ["0", "01"]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    nested = [0]
    while len(nested) < n:
        nested = nested * 3 + [len(nested)]
    t = {
        "one": [1] * n, "fibonacci": list(map(int, fib[-1][:n])), "blocks": [9 + k // 40 if k % 40 == 39 else 1 for k in range(n)], "thue": [bin(k).count("1") % 2 for k in range(n)],
        "period": [k * 7919 % 1013 for k in range(1000)] * 6, "random": np.random.default_rng(5).integers(0, 2, n).tolist(), "nested": nested[:n],
    }[kind]
    for s in (t, [-x for x in t]):
        Counted.looks = 0
        p.lyndon(Counted(s))
        assert Counted.looks < 14 * len(s)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_runs_lie_whole_in_one_zone(data):
    word = data.draw(st.lists(st.integers(0, 40), min_size=1, max_size=30))
    around = st.lists(st.integers(0, 60), max_size=150)
    t = data.draw(around) + word * data.draw(st.integers(3, 9)) + data.draw(around)
    assert p.runs_of(np.array(t, np.int64)) == brute_runs(t)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = brute_runs([ids[w] for w in words])
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    last = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *last, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents").collect()
    want = sorted(expected(r.doc_id, r.text) for r in docs)
    got = p.op11_lyndon_array_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(r[1] > 0 for r in want) > 10


def test_odd_rows(spark, odd, none):
    rows = p.periodic_runs(odd).collect()
    assert len(rows) == odd.count() and p.periodic_runs(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[11].runs[0].asDict() == {"start": 0, "length": 5000, "period": 1} and by[11].collapsed == "x"
    assert by[3].n_words == 0 and by[3].collapsed == "" and by[12].runs == [] and by[9].collapsed.startswith("é ü")
    assert p.periodic_runs(odd, 2, 2).where("doc_id = 11").first().collapsed == "x"
    with pytest.raises(ValueError):
        p.periodic_runs(odd, times=1)


def test_long_texts_and_words_of_any_length(spark):
    line = " ".join(f"w{k * 7919 % 5003}" for k in range(5000))
    texts = [line * 1 + (" " + line) * 5, ("z" * 100_000 + " ") * 30, "a\x00 a " * 20, "　 x " * 12]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in p.periodic_runs(rows).collect()}
    assert got == {0: [(0, 30000, 5000)], 1: [(0, 30, 1)], 2: [(0, 40, 2)], 3: [(0, 24, 2)]}
