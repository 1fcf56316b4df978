"""Session helpers: a tuned local session for tests/bench and a shared scratch folder.

On a cluster the caller owns the session; the library only reads settings from it.
"""
from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the library relies on: ANSI-safe expressions, UTC wall clock, AQE for
# runtime coalescing and skew-join splitting of hot label groups.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "flowlens",
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """Session for tests and the benchmark; a cluster job passes its own session instead."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    set_local_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``; the library never invents one.

    ``local_session`` and the entry module set it for local runs."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def set_local_checkpoint_dir(spark: SparkSession) -> None:
    """For sessions on one machine (tests, bench, smoke runs): a temporary folder if none is named."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="flowlens-ckpt-"))
    ensure_checkpoint_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for derived tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/flowlens/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def open_writers(spark: SparkSession, most: int = 32):
    """Writes by folders keep up to ``most`` files open in a task instead of sorting its rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: state on the executors' disks, with at most 500 MB of memory an executor; a batch logs its changes instead of uploading files
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; settings that the session has made itself stay."""
    own = [k for k in DISK_STATE if spark.conf.get(k, None) is None]
    for k in own:
        spark.conf.set(k, DISK_STATE[k])
    try:
        yield
    finally:
        for k in own:
            spark.conf.unset(k)


DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """A query that runs inside leaves no shuffle files behind when it ends (Spark 4.1), instead of keeping them until the driver collects garbage.

    A setting that the session has made itself stays."""
    own = spark.conf.get(DROPPED, None)
    try:
        spark.conf.set(DROPPED, "true" if own is None else own)
        yield
    finally:
        spark.conf.unset(DROPPED) if own is None else spark.conf.set(DROPPED, own)


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    spark = spark or df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def local_path(path: str) -> str:
    """Strip a file: scheme so Python-side helpers can stat local test folders."""
    return path[5:] if path.startswith("file:") else path
