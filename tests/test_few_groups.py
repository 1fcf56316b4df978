"""Rows of few large groups stay where they are: a join by group or label would give one task a whole group."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowlens.operators import split as SPL


@pytest.fixture()
def no_threshold(spark):
    """Spark's own estimate of a small table is no help here: after a checkpoint it may be that of the input."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def flows(spark):
    return spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), F.col("id") % 3)).alias("g"))


def test_split_of_few_groups_shuffles_no_rows(spark, no_threshold):
    s = SPL.stratified_two_way(flows(spark), "g", ["id"])
    assert "SortMergeJoin" not in plan(s) and "Exchange hashpartitioning" not in plan(s)
    assert {(r["g"], r["split"]): r["count"] for r in s.groupBy("g", "split").count().collect()} == {
        ("g1", "train"): 800, ("g1", "test"): 200, ("g2", "train"): 800, ("g2", "test"): 200}


def test_split_of_many_groups_is_the_same(spark, monkeypatch):
    expected = sorted(map(tuple, SPL.stratified_cap(flows(spark), "g", ["id"], 300).collect()), key=str)
    monkeypatch.setattr(SPL, "MOST_GROUPS", 1)
    assert sorted(map(tuple, SPL.stratified_cap(flows(spark), "g", ["id"], 300).collect()), key=str) == expected
    assert len(expected) == 300 and sum(r[1] is None for r in expected) == 100


def test_codes_of_few_labels_are_sent_to_the_rows(spark, no_threshold):
    from flowlens.operators import fit as FIT
    df = flows(spark)
    index = FIT.fit_label_index(df, "g")
    coded = FIT.decode_index(FIT.apply_label_index(df, index, "g", "y"), index, "g", "y", "name")
    coded = FIT.apply_category_encoder(coded, FIT.fit_category_encoder(df, ["g"]), ["g"])
    last = plan(coded)
    assert last.count("BroadcastHashJoin") >= 3 and "LeftOuter" not in "".join(x for x in last.split("\n") if "SortMergeJoin" in x)
    assert sorted(map(tuple, coded.groupBy("g", "y", "name").count().collect())) == [(-1, -1, "Class_-1", 1000), (0, 0, "g1", 1000), (1, 1, "g2", 1000)]
