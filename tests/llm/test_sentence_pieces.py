import zlib

import numpy as np
import corpus_pipeline
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import common
from quantloom.llm import sentence_pieces as s

P = s.Pieces(s.model_path())
SCORE = {P.sp.id_to_piece(int(i)): float(x) for i, x in zip(P.ids, P.scores)}
TEXT = st.text(alphabet="etaoin shrdlu\n\té漢🙂▁T.,", max_size=40)


def brute_viterbi(word):
    """Best sum of scores over all segmentations, position by position in plain Python."""
    best = [(0.0, [])]
    for j in range(1, len(word) + 1):
        found = []
        for i in range(max(0, j - P.longest), j):
            piece = word[i:j]
            if piece in SCORE or j - i == 1:
                found.append((best[i][0] + SCORE.get(piece, P.unknown_score), -i, best[i][1] + [piece]))
        top = max(found, key=lambda x: (x[0], x[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_viterbi_against_brute_force(texts):
    words = sorted({w for t in texts for w in P.word.findall(P.sp.normalize(t))})
    got = P.segment(words, rows=3)
    for w in words:
        want = [i for piece in brute_viterbi(w) for i in P._ids(piece)]
        assert np.frombuffer(got[w], P.kind).tolist() == want


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_round_trip(texts):
    for how in ("viterbi", "merges"):
        for t, ids in zip(texts, s.pieces(s.model_path(), how).encode(texts, how)):
            assert s.pieces(s.model_path(), how).decode(ids) == t.replace(s.MARK, " ")


def test_merges_are_those_of_the_library(sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist() + ["a  b   c\n\n d", "", " ", "漢字🙂 x"]
    got = s.Pieces(s.model_path()).encode(texts, "merges")
    assert [np.frombuffer(g, P.kind).tolist() for g in got] == P.sp.encode(texts)


def unigram_file(tmp_path):
    """A model file of type unigram with a few pieces, written field by field."""

    def field(number, kind, payload):
        return bytes([number << 3 | kind]) + (bytes([len(payload)]) + payload if kind == 2 else payload)

    def piece(text, score, kind=1):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind])))

    own = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3, 1), ("▁ab", -4.25, 1), ("ba", -3.5, 1), ("bab", -6.5, 1), ("▁a", -4, 1), ("c", -5, 1), ("abc", -6.125, 1)]
    path = tmp_path / "m.model"
    path.write_bytes(b"".join(piece(*p) for p in own) + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity") + field(4, 0, b"\x00")))
    return str(path)


def test_unigram_ids_are_those_of_the_library(tmp_path):
    path = unigram_file(tmp_path)
    p = s.Pieces(path)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aabbc  "), rng.integers(1, 25))) for _ in range(300)]
    for t, ids in zip(texts, p.encode(texts)):
        own = np.frombuffer(ids, p.kind).tolist()
        want = p.sp.encode(t)
        score = lambda ids: sum(p.sp.get_score(i) for i in ids)
        assert p.sp.decode(own) == p.sp.decode(want) and score(own) == pytest.approx(score(want))


def test_viterbi_over_the_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    rows = s.check(common.table(spark, sf, "documents"), how="viterbi").collect()
    assert len(rows) == len(texts) and all(r.lossless for r in rows)
    known = {}
    for r in rows:
        words = P.word.findall(P.sp.normalize(texts[r.doc_id] or ""))
        for w in set(words) - set(known):
            known[w] = [i for piece in brute_viterbi(w) for i in P._ids(piece)]
        ids = [i for w in words for i in known[w]]
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (r.viterbi_n_ids, r.viterbi_crc32)
    both = {r.doc_id: (r.viterbi_n_ids, r.viterbi_crc32, r.n_ids) for r in s.op8_viterbi_sentence_pieces(spark, sf).collect()}
    assert all(both[r.doc_id][:2] == (r.n_ids, r.ids_crc32) for r in rows) and sum(x[2] for x in both.values()) < sum(r.n_ids for r in rows)


def test_op8_and_the_pipeline_take_the_ids_of_the_model(spark, sf):
    docs = common.table(spark, sf, "documents")
    want = {r.doc_id: P.sp.encode(r.text or "") for r in docs.collect()}
    rows = s.op8_viterbi_sentence_pieces(spark, sf).collect()
    assert {r.doc_id: (r.n_ids, r.ids_crc32) for r in rows} == {k: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in want.items()}
    rows = corpus_pipeline.encode_pieces(spark, docs, sf).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), P.kind).tolist() for r in rows} == want


def test_long_words_merge_as_in_the_library():
    rng = np.random.default_rng(3)
    for n in (s.LONG - 1, s.LONG, s.LONG + 1, 5000):
        word = "".join(rng.choice(list("etaoinshré漢"), n))
        for t in (word, "a" * n):
            assert np.frombuffer(P.encode([t])[0], P.kind).tolist() == P.sp.encode(t)


def test_odd_rows(spark, odd, none):
    rows = s.check(odd).collect()
    assert len(rows) == odd.count() and all(r.lossless for r in rows)
    out = s.encode(odd)
    assert out.columns == [*odd.columns, "ids_2"]
    for r in out.collect():
        assert r.ids == "clash" and P.decode(bytes(r.ids_2)) == (r.text or "")
    assert s.encode(odd.drop("ids")).columns[-1] == "ids"
    assert s.check(none).count() == 0 and s.encode(none).count() == 0
