from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quantloom.llm import common, mixing, quality, sentence_pieces
from test_exact_dedup import brute as equal_groups
from test_ngram_join import brute_classes


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = common.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, docs := common.materialize(stage(spark, docs, sf), "test-stage")))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns_stay(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name


def plain_score(model, text):
    """Attention over 512-byte passages, one passage and one lag at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    hs, ss = [], []
    for at in range(0, max(1, len(raw)), quality.PASSAGE):
        part = raw[at : at + quality.PASSAGE]
        x, n = np.zeros(quality.FEATURES), max(1, len(part))
        for a, b in zip(part, part[1:]):
            x[quality._CLASS[a] * quality.CLASSES + quality._CLASS[b]] += 1 / n
        x[: quality.CLASSES**2] = np.sqrt(x[: quality.CLASSES**2])
        for k, lag in enumerate(quality.LAGS):
            x[quality.CLASSES**2 + k] = sum(a == b for a, b in zip(part, part[lag:])) / n
        h = np.tanh(x @ model["W"] + model["b"])
        hs.append(h)
        ss.append(float((np.tanh(h @ model["V"]) * sig(h @ model["U"])) @ model["w"][:, 0]))
    e = np.exp(np.array(ss) - max(ss))
    return float(sig((e / e.sum()) @ np.array(hs) @ model["c"][:, 0] + model["c0"][0]))


def test_quality_keeps_what_scores_well(spark, sf, stages):
    _, before, after = stages[0]
    model = quality.train(before, common.table(spark, sf, "labels"))
    scores = [(r.doc_id, plain_score(model, r.text)) for r in before.select("doc_id", "text").collect()]
    sure = {d for d, x in scores if abs(x - quality.THRESHOLD) > 1e-4}
    assert len(sure) > 0.99 * len(scores)
    assert sorted(set(ids(after)) & sure) == sorted({d for d, x in scores if x >= quality.THRESHOLD} & sure)


def test_exact_duplicates(stages):
    _, before, after = stages[1]
    want, _ = equal_groups(before.collect())
    assert sorted(map(repr, ids(after))) == sorted({k for _, k, _ in want})


def test_near_duplicates(stages):
    _, before, after = stages[2]
    want = brute_classes([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(map(repr, ids(after))) == sorted({c for _, c, _ in want})


def plain_mix(rows):
    """How often each doc_id is taken, by water-filling in plain Python."""
    import hashlib
    import re

    size = {r.doc_id: len(re.findall(mixing.WORD, r.text or "")) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r.doc_id)
    order = sorted(by, key=lambda x: (x is None, x or ""))
    total = {x: sum(size[d] for d in by[x]) for x in order}
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(order)}
    target, left, budget = {}, list(order), 1.5 * sum(total.values())
    while left:
        level = (budget - sum(target.values())) / sum(weight[x] for x in left)
        over = [x for x in left if weight[x] * level > 2 * total[x]]
        target |= {x: 2 * total[x] for x in over} if over else {x: weight[x] * level for x in left}
        left = [x for x in left if x in set(over) ^ set(left)] if over else []
    times, text = Counter(), {r.doc_id: r.text or "" for r in rows}
    place = lambda d: hashlib.md5(f"{mixing.SEED}:{'' if d is None else d}:{hashlib.md5(text[d].encode()).hexdigest()}".encode()).hexdigest()
    for x in order:
        whole = int(target[x] // total[x]) if total[x] else 0
        rest, seen = target[x] - whole * total[x], 0
        for d in sorted(by[x], key=place):
            times[d] += whole + (rest > 0 and seen + size[d] / 2 <= rest)
            seen += size[d]
    return +times


def test_mix(stages):
    _, before, after = stages[3]
    assert Counter(ids(after)) == plain_mix(before.collect())


def test_run_is_its_stages(spark, sf, stages):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "text", "ids", "n_ids"]
    key = lambda r: (r.doc_id, bytes(r.ids))
    assert sorted(map(key, out.collect())) == sorted(map(key, stages[4][2].collect()))


def test_pieces(stages):
    _, before, after = stages[4]
    p = sentence_pieces.Pieces(sentence_pieces.model_path())
    rows = after.collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids(before))
    assert all(p.decode(bytes(r.ids)) == r.text and r.n_ids == len(r.ids) // 2 for r in rows)


def test_odd_rows(spark, sf, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count(), name
        assert corpus_pipeline.encode_pieces(spark, docs, sf).count() == docs.count()
