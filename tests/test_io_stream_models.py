"""Sources (mixed-header CSV folders, audits, manifests), sinks, streaming and the model suite."""
from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators import fit as FIT
from flowlens.sources import csv as CSV
from flowlens.sources import files as FILES
from flowlens.sources import sinks as SNK
from flowlens.streaming import stream as STR


def _write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_folder_load_groups_headers(spark, tmp_dir):
    _write(f"{tmp_dir}/DDoS/a.csv", " x , y ,Label\n1,2,DDoS\n3,4,DDoS\n")
    _write(f"{tmp_dir}/Recon/b.csv", "y,x,Label,z\n20,10,Recon,7\n40,30,Recon,8,99\n50,60\n")
    df = CSV.load_folder(spark, tmp_dir, "iot", numeric=["x", "y", "z"])
    rows = sorted((r["Attack_Category"], r["x"], r["y"], r["z"]) for r in df.collect())
    # columns align by name, the over-long row is skipped, the short row is padded with NULL
    assert rows == [("DDoS", 1.0, 2.0, None), ("DDoS", 3.0, 4.0, None), ("Recon", 10.0, 20.0, 7.0),
                    ("Recon", 60.0, 50.0, None)]
    assert {r["Source_File"] for r in df.collect()} == {"a.csv", "b.csv"}
    assert CSV.read_header(spark, f"{tmp_dir}/Recon/b.csv") == ["y", "x", "Label", "z"]
    with pytest.raises(FileNotFoundError):
        CSV.load_csv(spark, f"{tmp_dir}/missing.csv")
    with pytest.raises(ValueError):
        CSV.load_csv(spark, f"{tmp_dir}/DDoS/a.txt")


def test_audit_and_manifest(spark, tmp_dir):
    _write(f"{tmp_dir}/ok.csv", "a,b\n1,2\n")
    _write(f"{tmp_dir}/empty.csv", "")
    _write(f"{tmp_dir}/bin.csv", "a,b\n\x00\x01\n")
    _write(f"{tmp_dir}/notes.txt", "hello\n")
    a = {os.path.basename(r["path"]): r["problem"] for r in FILES.audit(spark, tmp_dir).collect()}
    assert a == {"ok.csv": None, "empty.csv": "empty file", "bin.csv": "binary content (NUL bytes)",
                 "notes.txt": "not a CSV file"}
    m = FILES.manifest(spark, tmp_dir, glob="*.csv")
    assert all(len(r["sha256"]) == 64 for r in m.collect())
    exp = m.withColumn("sha256", F.when(F.col("name") == "ok.csv", F.lit("0" * 64)).otherwise(F.upper("sha256"))) \
        .where(F.col("name") != "bin.csv")
    st = {r["name"]: r["state"] for r in FILES.verify_manifest(m, exp).collect()}
    assert st == {"ok.csv": "changed", "empty.csv": "ok", "bin.csv": "new"}


def test_contract_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1.0, 10.0, "a"), (3.0, 30.0, "b")], "f1 double, f2 double, label string")
    sc = FIT.fit_scaler(df, ["f1", "f2"], "minmax")
    idx = FIT.fit_label_index(df, "label")
    SNK.export_contract(spark, f"{tmp_dir}/c", ["f1", "f2"], "label", sc, label_index=idx)
    doc = SNK.load_contract(spark, f"{tmp_dir}/c")
    assert doc["features"] == ["f1", "f2"] and doc["scaler_params"].values == sc.values
    assert sorted(r["label"] for r in doc["label_index"].collect()) == ["a", "b"]


def test_registry_log_latest(spark, tmp_dir):
    from flowlens.operators import serve as SRV
    path = f"{tmp_dir}/registry"
    SNK.log_status(spark, path, "d1", "processing")
    SNK.log_status(spark, path, "d1", "processed", rows=10, is_valid=True)
    SNK.log_status(spark, path, "d2", "processing")
    SNK.log_status(spark, path, "d2", "deleted")
    live = SRV.live_registry(spark.read.parquet(path), "dataset_id", "ts")
    assert [(r["dataset_id"], r["status"], r["rows"]) for r in live.collect()] == [("d1", "processed", 10)]


def test_stream_requires_fit_and_matches_batch(spark, tmp_dir):
    with pytest.raises(RuntimeError):
        STR.fitted_transform(None, None)
    df = spark.createDataFrame([(float(i), "n" if i % 3 else "a") for i in range(60)], "x double, label string")
    df.repartition(4).write.parquet(f"{tmp_dir}/in")
    p = FIT.fit_scaler(df, ["x"], "minmax")
    t = STR.fitted_transform(None, p, "label", benign=["n"])
    src = STR.file_stream(spark, f"{tmp_dir}/in", df.schema, max_files_per_trigger=1)
    q = (t(src).writeStream.format("memory").queryName("stream_vs_batch").option("checkpointLocation", f"{tmp_dir}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("stream_vs_batch").collect())
    exp = sorted(tuple(r) for r in t(df).collect())
    assert got == exp
    assert STR.throughput(q)["rows"] == 60


def test_model_suite(spark):
    from flowlens.operators.models import ModelSuite
    with pytest.raises(ValueError):
        ModelSuite(["xgboost"])
    df = spark.createDataFrame([(float(i % 7), float(i % 3), "a" if i % 2 else "b") for i in range(200)],
                               "f1 double, f2 double, label string")
    suite = ModelSuite(["decision_tree", "naive_bayes"])
    with pytest.raises(RuntimeError):
        suite.predict(df, "decision_tree")
    suite.fit(df, ["f1", "f2"], "label")
    pred = suite.predict(df, "decision_tree")
    assert set(r["prediction"] for r in pred.select("prediction").distinct().collect()) <= {"a", "b"}
    proba = suite.predict_proba(df, "naive_bayes").select("probability").first()[0]
    assert len(proba) == 2 and abs(sum(proba) - 1) < 1e-9


def test_payload_checks(spark):
    from flowlens.operators import shape as SH
    df = spark.createDataFrame([('{"a": "1", "b": "true"}',), ('{"a": "x"}',), ('[1, 2]',), ("{}",)], "p string")
    out = SH.payload_to_features(df, "p", ["a", "b"], keep=["p"]).collect()
    got = {r["p"]: (r["payload_error"], r["a"], r["b"]) for r in out}
    assert got['{"a": "1", "b": "true"}'] == (None, 1.0, 1.0)
    assert got['{"a": "x"}'][0] == "missing features: b"
    assert got["[1, 2]"][0] == "payload is not a JSON object"
    assert got["{}"][0] == "features must not be empty"
    assert C.PAYLOAD_MAX_KEYS == 500


def test_a_replayed_batch_replaces_its_rows(spark, tmp_dir):
    from flowlens.sources.sinks import write_records_and_alerts
    batch = spark.createDataFrame([(i, "error" if i % 2 else "ok", "DoS" if i % 2 else "Normal", "high") for i in range(10)],
                                  "id long, label string, category string, severity string")
    for epoch in (0, 1, 1, 0):
        write_records_and_alerts(batch, f"{tmp_dir}/r", f"{tmp_dir}/a", "id", "label", epoch=epoch)
    assert spark.read.parquet(f"{tmp_dir}/r").count() == 20 and spark.read.parquet(f"{tmp_dir}/a").count() == 10


def test_stream_dedup_keeps_rows_out_of_time_order(spark, tmp_dir):
    import datetime
    day = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    for k, rows in enumerate(([(day(900), 1)], [(day(0), 2), (day(900), 1)], [(day(400), 3), (day(0), 2)], [(day(1), 4)])):
        spark.createDataFrame(rows, "ts timestamp, x long").coalesce(1).write.parquet(f"{tmp_dir}/in/{k}")
    src = spark.readStream.schema("ts timestamp, x long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in")
    q = STR.to_table(STR.dedup_stream(src, None, ["ts", "x"], "1 hour"), f"{tmp_dir}/out", f"{tmp_dir}/ck")
    q.awaitTermination()
    assert sorted(r["x"] for r in spark.read.parquet(f"{tmp_dir}/out").collect()) == [1, 2, 3, 4]


def test_stream_dedup_keeps_its_state_off_the_heap(spark, tmp_dir):
    from flowlens.session import DISK_STATE
    for k in range(3):
        spark.range(k * 50, k * 50 + 100).selectExpr("id", "if(id % 7 = 0, null, cast(id as string)) AS s").coalesce(1).write.parquet(f"{tmp_dir}/in/{k}")
    src = spark.readStream.schema("id long, s string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in")
    q = STR.to_table(STR.dedup_stream(src, None, ["id", "s"], "1 hour"), f"{tmp_dir}/out", f"{tmp_dir}/ck")
    assert all(spark.conf.get(k, None) is None for k in DISK_STATE)  # the session is as before
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_dir}/out").collect()) == list(range(200))
    states = [s for p in q.recentProgress for s in p.stateOperators]
    assert states and all("rocksdbPutCount" in s.customMetrics for s in states)


def test_streams_read_tables_of_several_files(spark, tmp_dir):
    from flowlens.plans.catalog_misc import table_stream
    df = spark.range(100)
    df.repartition(3).write.parquet(f"{tmp_dir}/many.parquet")
    df.coalesce(1).write.parquet(f"{tmp_dir}/tmp")
    import glob
    import shutil
    shutil.copy(glob.glob(f"{tmp_dir}/tmp/part-*.parquet")[0], f"{tmp_dir}/one.parquet")
    for name in ("many", "one"):
        q = STR.to_table(table_stream(spark, tmp_dir, name, df.schema), f"{tmp_dir}/out-{name}", f"{tmp_dir}/ck-{name}")
        q.awaitTermination()
        assert spark.read.parquet(f"{tmp_dir}/out-{name}").count() == 100


def test_latin_files_are_told_by_path_not_by_name(spark, tmp_dir):
    import os
    from flowlens.sources.csv import read_all_csv
    for folder, encoding in (("A", "utf-8"), ("B", "latin-1")):
        os.makedirs(f"{tmp_dir}/{folder}")
        with open(f"{tmp_dir}/{folder}/p.csv", "w", encoding=encoding) as f:
            f.write("name,x\ncaf\u00e9,1\n")
    assert [r["name"] for r in read_all_csv(spark, tmp_dir).collect()] == ["caf\u00e9"] * 2
