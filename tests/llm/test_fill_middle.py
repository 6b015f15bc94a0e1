import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sqlcheck import check

from quantloom.llm import common
from quantloom.llm import fill_middle as f


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=700) | st.text(alphabet="é漢\U0001f600a", max_size=1500))
def test_boundaries_of_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    raw = text.encode()
    found = f.Boundaries(f.encode(raw))
    assert found.count == len(text) + 1
    assert [found.select(k) for k in range(found.count)] == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_long_texts_take_two_bits_a_code_point_and_a_directory():
    raw = ("漢" * 50_000 + "\U0001f600" * 50_000).encode()
    got = f.encode(raw)
    assert len(got) < 100_001 * 4 / 8 + 600 * 4 + 1000
    assert f.Boundaries(got).select(70_000) == 150_000 + 80_000


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{text[j:]}<P>{text[:i]}<M>{text[i:j]}" if form == "spm" else f"<P>{text[:i]}<S>{text[j:]}<M>{text[i:j]}"
    return n, form, i, j - i, out


def same(docs, digest=f.sha256_digest):
    want = sorted(((r.doc_id, *brute(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in f.fill_middle(docs, digest=digest).collect()), key=repr) == want


def test_odd_rows(spark, odd, none):
    same(odd)
    assert f.fill_middle(none).count() == 0
    marks = [(k, t) for k, t in enumerate(["a<P>b", "<S>", "x<M>", "<<S", "<P", "P>é", "ab<", ">S<"] * 30)]
    same(spark.createDataFrame(marks, "doc_id long, text string"))


def test_copies_and_collisions(spark):
    texts = ["same é text", "same é text", "other", "x" * 300_000, "x" * 300_000, ""] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    same(docs)
    poor = lambda text: F.unhex(F.hex(F.length(text) % 2))
    assert f.indexed(docs, poor).where("bounds IS NULL").count() > 0  # a text that only shares a digest is an entry of its own
    same(docs, poor)


def test_outputs_are_restored(spark, sf):
    docs = common.table(spark, sf, "documents")
    out = f.fill_middle(docs).withColumn("back", f.restore(F.col("output"), F.col("form")))
    assert out.join(docs, "doc_id").where(~F.col("back").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op12_against_sql(spark, size):
    path = f"/root/testdata/{size}"
    check(f.op12_distinct_text_fill_middle(spark, path), f.OP12_SQL, path)
