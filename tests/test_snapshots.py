"""Committed epochs, the training loader and exact deduplication across micro-batches."""
from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from flowlens.operators.fit import Params
from flowlens.sources import snapshots as SN
from flowlens.streaming import exact as EX


def records(spark, rows):
    return spark.createDataFrame(rows, "id long, event string, category string, severity string")


def test_records_and_alerts_appear_together(spark, tmp_dir, monkeypatch):
    log = SN.SnapshotLog(spark, f"{tmp_dir}/log")
    assert log.latest() is None and log.read("records") is None
    assert SN.commit_records_and_alerts(log, records(spark, [(1, "x", "DoS", "high"), (2, "y", "Normal", "none")]), 0, "id", "event")
    second = records(spark, [(3, "x", "Probe", "low"), (4, "x", "DoS", "high")])
    from flowlens.operators import score
    with monkeypatch.context() as m:
        m.setattr(score, "alerts_from_records", lambda *a, **k: (_ for _ in ()).throw(OSError("the second write fails")))
        with pytest.raises(OSError):
            SN.commit_records_and_alerts(log, second, 1, "id", "event")
    # records of epoch 1 are on disk, but no reader sees them without its alerts
    assert log.latest() == 0 and log.read("records").count() == 2 and log.read("alerts").count() == 1
    assert SN.commit_records_and_alerts(log, second, 1, "id", "event")
    assert not SN.commit_records_and_alerts(log, second, 1, "id", "event")  # a replay
    assert sorted(r.id for r in log.read("records").collect()) == [1, 2, 3, 4] and log.read("alerts").count() == 3
    assert log.read("records", 0).count() == 2 and log.read("alerts", 0).count() == 1  # an older snapshot stays readable
    assert log.read("records", 1, 0).count() == 2
    with pytest.raises(RuntimeError):
        late = log.attempt(1)
        late.put("records", second)
        late.commit()
    assert log.read("records").count() == 4
    with pytest.raises(ValueError):
        log.attempt(2).put("no/name", second)


def test_training_versions(spark, tmp_dir):
    log = SN.SnapshotLog(spark, f"{tmp_dir}/training")
    with pytest.raises(FileNotFoundError):
        SN.load_training(log)
    rows = spark.createDataFrame([(1.0, 2.0, "a", "train"), (3.0, 4.0, "b", "train"), (5.0, 6.0, "a", "test")], "x double, `y z` double, label string, split string")
    scaler, imputer = Params("minmax", {"x": {"min": 1.0}}), Params("median", {"x": {"fill": 2.0}})
    index = spark.createDataFrame([("a", 0), ("b", 1)], "label string, code int")
    assert SN.publish_training(log, 1, rows, ["x", "y z"], "label", scaler)
    assert SN.publish_training(log, 2, rows.where("x > 1"), ["x", "y z"], "label", scaler, imputer, index, rows.where("label = 'b'"))
    assert not SN.publish_training(log, 2, rows, ["x"], "label", scaler)
    new, old = SN.load_training(log), SN.load_training(log, 1)
    assert new["version"] == 2 and {k: v.count() for k, v in new["splits"].items()} == {"train": 1, "test": 1}
    assert {k: v.count() for k, v in old["splits"].items()} == {"train": 2, "test": 1}
    assert old["zero_day"] is None and old["imputer"] is None and old["label_index"] is None
    assert new["zero_day"].count() == 1 and new["imputer"].values == imputer.values and new["scaler"].kind == "minmax"
    assert new["contract"]["features"] == ["x", "y z"] and sorted(map(tuple, new["label_index"].collect())) == [("a", 0), ("b", 1)]
    # an attempt without a commit is no version
    log.attempt(3).put("splits", rows, ["split"])
    assert SN.load_training(log)["version"] == 2
    with pytest.raises(FileNotFoundError):
        SN.load_training(log, 3)
    SN.publish_training(log, 4, rows.drop("x"), ["x", "y z"], "label", scaler)
    with pytest.raises(ValueError):
        SN.load_training(log)


ROWS = [(1, "a", 10.0, 100), (2, None, -0.0, 5000), (2, "", 0.0, 5000), (3, "a", math.nan, 9000), (None, None, None, None), (4, "b", 1.0, 200)]


def batches_of(spark):
    frame = lambda picks: spark.createDataFrame([ROWS[i] for i in picks], "id long, s string, x double, t long").withColumn("t", F.timestamp_seconds("t"))
    return [frame([0, 1, 1, 3]), frame([3, 2, 0, 4]), frame([5, 1, 4, 5])]


def key(rows):
    return sorted(repr((r.id, r.s, None if r.x is None else str(r.x + 0.0), r.t)) for r in rows)


def test_any_order_of_batches_gives_the_distinct_rows(spark, tmp_dir):
    parts = batches_of(spark)
    want = key(parts[0].union(parts[1]).union(parts[2]).dropDuplicates().collect())
    assert len(want) == 6
    for n, order in enumerate(itertools.permutations(range(3))):
        log = SN.SnapshotLog(spark, f"{tmp_dir}/order{n}")
        assert EX.distinct_rows(log) is None
        for epoch, i in enumerate(order):
            assert EX.dedup_epoch(log, parts[i], epoch, ts="t", delay_seconds=600, parts=4)
            assert not EX.dedup_epoch(log, parts[i], epoch, ts="t", delay_seconds=600, parts=4)
        assert key(EX.distinct_rows(log).collect()) == want
        late = EX.distinct_rows(log, late=True).collect()
        assert key(late) + key(EX.distinct_rows(log, late=False).collect()) != [] and len(late) + EX.distinct_rows(log, late=False).count() == 6
        if order == (0, 1, 2):  # 5000 and 200 are far behind 9000, which the first batch held
            assert sorted(r.id for r in late) == [2, 4]


def test_a_failed_epoch_leaves_no_trace(spark, tmp_dir, monkeypatch):
    parts = batches_of(spark)
    log = SN.SnapshotLog(spark, f"{tmp_dir}/fail")
    EX.dedup_epoch(log, parts[0], 0)
    with monkeypatch.context() as m:
        m.setattr(SN.Attempt, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("no commit")))
        with pytest.raises(OSError):
            EX.dedup_epoch(log, parts[1], 1)
    before = EX.distinct_rows(log).count()
    assert before == 3
    EX.dedup_epoch(log, parts[1], 1)
    EX.dedup_epoch(log, parts[2].limit(0), 2)
    EX.dedup_epoch(log, parts[2], 3, columns=None)
    assert EX.distinct_rows(log).count() == 6


def test_streams_end_in_committed_epochs(spark, tmp_dir):
    parts = batches_of(spark)
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{tmp_dir}/in/{i}")
    src = lambda: spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/in")
    log = SN.SnapshotLog(spark, f"{tmp_dir}/stream")
    for _ in range(2):  # a second run finds nothing new
        EX.dedup_to_log(src(), log, f"{tmp_dir}/ckpt", ts="t", parts=3).awaitTermination()
        assert EX.distinct_rows(log).count() == 6 and log.latest() == 2
    named = src().select("id", F.coalesce("s", F.lit("none")).alias("event"), F.lit("DoS").alias("category"), F.lit("high").alias("severity"))
    alerts = SN.SnapshotLog(spark, f"{tmp_dir}/alerts")
    EX.score_to_log(named, alerts, f"{tmp_dir}/ckpt2", "id", "event").awaitTermination()
    n = alerts.latest()
    assert alerts.read("records", n).count() == alerts.read("alerts", n).count() == 12
