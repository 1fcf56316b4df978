"""Files as rows: listings, first bytes, headers and digests, all made in tasks.

Directories are listed level by level, each in some task; first lines and digests are read where their file's row is.
A file is read as a stream with a buffer of fixed size, so its length does not matter. Paths go through pyarrow's file
systems (local or mounted folders, HDFS, object stores); ``readable`` tells whether a store is one of them.
"""
from __future__ import annotations

import csv
import fnmatch
import hashlib
import sys

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

BUFFER = 8 << 20
FILES = "path string, length bigint, modified timestamp, directory boolean"


def place(path: str):
    """(file system, path within it) of a path as Spark writes it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, inner = rest.lstrip("/").partition("/") if rest.startswith("//") else ("", "", rest.lstrip("/"))
    system, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{inner}" if base.strip("/") else f"/{inner}"


def readable(path: str) -> bool:
    try:
        place(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _list_directories(batches):
    for batch in batches:
        paths, sizes, times, kinds = [], [], [], []
        for directory in batch.column(0).to_pylist():
            system, inner = place(directory)
            for info in system.get_file_info(pafs.FileSelector(inner)):
                if info.base_name.startswith(".") and info.base_name.endswith(".crc"):
                    continue  # checksums that Hadoop keeps beside local files
                paths.append(f"{directory.rstrip('/')}/{info.base_name}")
                sizes.append(info.size if info.is_file else None)
                times.append(info.mtime)
                kinds.append(info.type == pafs.FileType.Directory)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC")), pa.array(kinds, pa.bool_())],
                                         names=["path", "length", "modified", "directory"])


def list_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length and modified of every file below ``root`` (empty ones too) whose name fits ``glob``.

    One round per level of folders; no entry passes through the driver."""
    from ..session import cut_lineage
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    found = None
    while True:
        here = cut_lineage(level.mapInArrow(_list_directories, FILES))
        files = here.where("not directory").drop("directory")
        found = files if found is None else found.union(files)
        level = here.where("directory").select("path")
        if level.isEmpty():
            break
        level = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(name.rlike(fnmatch.translate(glob).removesuffix(r"\Z") + r"\z"))


def _first_bytes(most: int):
    def run(batches):
        for batch in batches:
            heads = []
            for path in batch.column(0).to_pylist():
                system, inner = place(path)
                with system.open_input_stream(inner, buffer_size=0) as f:
                    heads.append(f.read(most))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], names=["path", "head"])
    return run


def first_bytes(paths: DataFrame, most: int = 8192) -> DataFrame:
    """path and the first ``most`` bytes of each file; no more is read."""
    return paths.select("path").mapInArrow(_first_bytes(most), "path string, head binary")


def _headers(encoding: str):
    def run(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, inner = place(path)
                line = b""
                with system.open_input_stream(inner, buffer_size=0) as f:
                    while b"\n" not in line and b"\r" not in line:
                        more = f.read(1 << 16)
                        if not more:
                            break
                        line += more
                text = line.decode(encoding, "replace").removeprefix("﻿").splitlines()
                found.append([c.strip() for c in next(csv.reader(text[:1]))] if text and text[0] else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["path", "header"])
    return run


def headers(paths: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """path and the stripped names of the first line of each file (an empty array for an empty file or line)."""
    return paths.select("path").mapInArrow(_headers(encoding), "path string, header array<string>")


def _digest(batches):
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            system, inner = place(path)
            running = hashlib.sha256()
            with system.open_input_stream(inner, buffer_size=0) as f:
                while part := f.read(BUFFER):
                    running.update(part)
            digests.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["path", "sha256"])


def digests(paths: DataFrame) -> DataFrame:
    """path and SHA-256 of each file, read once in order with a buffer of BUFFER bytes."""
    return paths.select("path").mapInArrow(_digest, "path string, sha256 string")
