"""Rows are dealt by hash before duplicates are looked for: the task of a scan holds no table of all its rows."""
from __future__ import annotations

import datetime as dt

from flowlens.operators import quality as VAL
from flowlens.operators import shape as SH


def below_exchange(df, key: str) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index(f"hashpartitioning({key}"):]


def test_no_aggregate_in_the_task_of_a_scan(spark):
    df = spark.range(100).selectExpr("id", "id * 1.5d AS x", "cast(id AS string) AS s")
    assert "Aggregate" not in below_exchange(SH.drop_duplicates(df), "__deal")
    assert "Aggregate" not in below_exchange(VAL.duplicate_counts(df), "a")


def test_dealt_duplicates_are_those_of_grouping(spark):
    nan, day = float("nan"), dt.date(2024, 1, 1)
    rows = [(1, 0.0, "a", day, [0.0]), (1, -0.0, "a", day, [-0.0]), (1, nan, "a", day, [nan]), (1, nan, "a", day, [nan]), (None, 1.0, None, None, None),
            (None, 1.0, None, None, None), (1, None, "a", day, [1.0]), (None, 1.0, "", None, None), (1, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, "k int, x double, s string, d date, v array<double>").repartition(4)
    assert SH.drop_duplicates(df).count() == df.dropDuplicates().count() == df.distinct().count() == 6
    assert SH.drop_duplicates(df).columns == df.columns
    nested = df.select("v")  # no column to deal by
    assert SH.drop_duplicates(nested).count() == nested.distinct().count()
    assert SH.drop_duplicates(df.limit(0)).count() == 0


def test_split_that_is_kept_holds_only_what_is_read(spark):
    from flowlens.plans import catalog_fit as CF

    from .conftest import SF_SMALL
    assert CF._split_lineitem(spark, SF_SMALL).columns == ["split", *CF.FEATS]


def test_an_epoch_deals_its_rows_once(spark, tmp_path, monkeypatch):
    from flowlens.sources import snapshots as SN
    from flowlens.streaming import exact as EX
    plans, put = [], SN.Attempt.put

    def spy(self, name, df, partition_by=()):
        if name == "rows":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, name, df, partition_by)
    monkeypatch.setattr(SN.Attempt, "put", spy)
    log = SN.SnapshotLog(spark, str(tmp_path / "log"))
    batch = spark.range(20).selectExpr("id % 7 AS k", "cast(id % 7 AS string) AS s")
    assert EX.dedup_epoch(log, batch, 0) and EX.dedup_epoch(log, batch.union(spark.range(7, 9).selectExpr("id", "'new'")), 1)
    assert sorted(map(tuple, EX.distinct_rows(log).select("k", "s").collect())) == [*((k, str(k)) for k in range(7)), (7, "new"), (8, "new")]
    assert "Aggregate" not in plans[1] and plans[1].count("hashpartitioning(") == 1, plans[1]  # an index this small is sent
