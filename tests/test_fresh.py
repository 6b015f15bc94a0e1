"""Answers follow the files: nothing that an earlier query kept is used again, and no query leaves anything persisted."""

import shutil

import pytest
from pyspark.sql import functions as F

from quantloom.plans import catalog

NAMES = ["portfolio_valuation", "action_board", "allocation"]


@pytest.mark.parametrize("name", NAMES)
def test_a_replaced_file_changes_the_answer(spark, sf, tmp_path, name):
    for table in ("part", "lineitem", "customer", "documents", "orders"):
        shutil.copy(f"{sf}/{table}.parquet", tmp_path / f"{table}.parquet")
    ask = lambda: sorted(map(repr, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    before = ask()
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 2 = 0").withColumn("l_extendedprice", F.col("l_extendedprice") * 3)
    rows.coalesce(1).write.parquet(str(tmp_path / "new"))
    (part,) = (tmp_path / "new").glob("part-*.parquet")
    shutil.copy(part, tmp_path / "lineitem.parquet")
    spark.catalog.refreshByPath(str(tmp_path / "lineitem.parquet"))
    after = ask()
    assert after != before and ask() == after
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
