import zlib

import numpy as np
import pytest

from quantloom.llm import common
from quantloom.llm import quality as q


def test_passages_cover_whole_texts():
    ends = np.cumsum([0, 5, 0, 1024, 513])
    start, end, doc = q.passage_bounds(ends)
    assert doc.tolist() == [0, 1, 2, 3, 3, 4, 4]
    assert (end - start).tolist() == [0, 5, 0, 512, 512, 512, 1]


def test_features_dont_depend_on_neighbours():
    texts = [b"abc abc abc", b"", b"XYZ!!", b"q" * 1300]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    start, end, doc = q.passage_bounds(ends)
    all_at_once = q.features(raw, start, end)
    for k, t in enumerate(texts):
        one = np.frombuffer(t, np.uint8)
        s, e, _ = q.passage_bounds(np.array([len(t)]))
        assert np.allclose(q.features(one, s, e), all_at_once[doc == k])


def test_gradients_are_those_of_the_loss():
    t = q.Training(hidden=4, gate=3)
    rng = np.random.default_rng(1)
    p = q.initial(t)
    x, bag, y, w = rng.random((7, q.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0, 1]), np.array([0.5, 2, 1])

    def loss(p):
        s = q.attend(p, x, bag, 3)["score"]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    got = q.gradients(p, x, bag, y, w)
    for k in p:
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        up, down = {a: b.copy() for a, b in p.items()}, {a: b.copy() for a, b in p.items()}
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert got[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-7)


def test_scores_in_chunks_equal_attention_over_the_whole_text(monkeypatch):
    p = {k: v.astype(np.float32) for k, v in q.initial(q.Training(hidden=4, gate=3)).items()}
    texts = [b"Some words. " * 300, b"", b"MORE!! " * 90]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    start, end, doc = q.passage_bounds(ends)
    whole = q.attend(p, q.features(raw, start, end), doc, 3)["score"]
    monkeypatch.setattr(q, "_CHUNK", 4)
    assert np.allclose(q.score_texts(p, raw, ends), whole, atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op3_attention_mil_quality(spark, sf)
    rows = got.join(common.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert got.count() == common.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_odd_rows(spark, odd, none, sf):
    labels = common.table(spark, sf, "labels")
    model = q.train(common.table(spark, sf, "documents"), labels, q.Training(epochs=1))
    out = q.score(odd, model)
    rows = out.select("row.doc_id", "row.text", "score").collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r.text or "", r.score) == pytest.approx(r.score, abs=1e-6)
    assert q.score(none, model).count() == 0
    kept = q.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 0
    seen, other = [i for i in (3, 5, 7, 9, 11, 12, 13) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    bad = spark.createDataFrame([(None, 1), (seen, None), (seen, 1), (seen, 1), (other, 1)], "doc_id long, quality int")
    assert q.train(odd, bad)["prior"] == pytest.approx([3 / 4])
