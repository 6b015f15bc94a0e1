from collections import defaultdict

from pyspark.sql import functions as F
from sqlcheck import check

from quantloom.llm import common
from quantloom.llm import exact_dedup as x


def test_op5_equals_sql(spark, sf):
    check(x.op5_lsm_exact_dedup(spark, sf), x.OP5_SQL, sf)


def brute(rows):
    import re

    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    return sorted((repr(d), repr(min((i for i in ids if i is not None), default=None)), len(ids)) for ids in groups.values() for d in ids), len(groups)


def test_odd_rows(spark, odd, none):
    rows = odd.collect()
    out = x.dedup(odd)
    want, groups = brute(rows)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size) for r in out.collect()) == want
    assert out.where("kept").count() == groups
    assert x.dedup(none).count() == 0
    kept = x.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == groups
    assert x.keep_first(none).columns == none.columns and x.keep_first(none).count() == 0


def test_colliding_digests_are_told_apart_by_their_bytes(spark, sf, odd):
    weak = lambda t: F.substring(x.sha256_digest(t), 1, 1)
    for docs in (odd, common.table(spark, sf, "documents")):
        want, groups = brute(docs.collect())
        out = x.dedup(docs, weak)
        assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size) for r in out.collect()) == want
        assert out.where("kept").count() == groups


def test_null_ids_alone_keep_one(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a  b"), (None, "c")], "doc_id long, text string")
    assert x.keep_first(df).count() == 2
    assert sorted((r.group_size, r.kept) for r in x.dedup(df).collect()) == [(1, True), (2, False), (2, True)]


def test_index_grows_by_runs_and_compacts(spark):
    index = x.DigestIndex(spark, common.scratch_path(spark, "t"))
    assert index.read().count() == 0
    digests = spark.range(100).select(F.unhex(F.sha2((F.col("id") % 40).cast("string"), 256)).alias("digest"), F.col("id").alias("doc_id"))
    sizes = []
    for k in range(5):
        index.flush(digests.where(f"doc_id div 20 = {4 - k}"))
        sizes.append(len(index.runs))
    assert sizes == [1, 2, 3, 1, 2] and index.read().agg(F.sum("n")).first()[0] == 100
    index.compact()
    rows = index.read().collect()
    assert len(index.runs) == 1 and len(rows) == 40
    assert sorted(r.keep_id for r in rows) == list(range(40)) and sum(r.n for r in rows) == 100
    import hashlib

    assert [r.keep_id for r in index.probe([hashlib.sha256(b"7").digest()]).collect()] == [7]
    assert index.probe([b"none"]).count() == 0


def test_key_filter_never_excludes_a_key(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    f = common.KeyFilter(keys, "k")
    rows = f.split(spark.range(30_000).select(F.col("id").cast("string").alias("x")), F.col("x")).select("x", "__maybe").collect()
    assert len(rows) == 30_000 and all(r["__maybe"] for r in rows if int(r.x) < 3000 and int(r.x) % 3 == 0)
    assert sum(r["__maybe"] for r in rows) < 1000 + 0.1 * 30_000
    empty = common.KeyFilter(keys.limit(0), "k").split(keys, F.col("k"))
    assert empty.where("__maybe").count() == 0 and empty.count() == 1000
