"""Token ids as files of independent zstandard frames with a trailing seek table.

File layout (one file per shard, shards in ascending document order):

* data frames: the ids of one or more whole documents, little-endian unsigned 32-bit, each
  frame a zstandard frame of its own that carries a content checksum;
* a skippable frame with the document index: for every document its id, its frame, its
  place in the frame and its number of ids;
* a skippable frame with the seek table of the public seekable zstandard format: compressed
  size, plain size and checksum (the low 32 bits of XXH64) of every frame, then the footer.

A reader takes the two trailing frames, then decompresses only the frames of the documents
it wants. Files go to the shared folder of ``spark.checkpoint.dir`` under a name of the
attempt and are moved to their final name at the end, so a repeated or lost task leaves
either a whole file or none; the rows that describe them are written once.

Null text: no ids but the end id. Null ids come first. Repeated rows are separate
documents; rows of one id are in the order of a hash of their text. Other columns are not read.
"""
from __future__ import annotations

import itertools
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import textkernel as K
from .common import written

FRAME_IDS = 1 << 16      # a frame closes when it holds so many ids; a longer document has its own
CACHE_WORDS = 300_000    # words whose ids a task remembers
# Fixed values of the file format.
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
INDEX_ROW = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("offset", "<u4"), ("n_tokens", "<u8")])
SEEK_ROW = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])


def checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def byte_symbols() -> dict[int, int]:
    """Byte-level BPE writes a byte that prints as itself and the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(rest)}}


class WordEncoder:
    """Ids of pre-tokens from the tokenizers library, each distinct one encoded once while remembered.

    Texts that hold the string of an added token go to the library whole."""

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.symbols = byte_symbols()
        self.end = [end_id]
        self.known: dict[bytes, list[int]] = {}

    def ids(self, word: bytes) -> list[int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            got = self.known[word] = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.symbols))]
        return got

    def documents(self, data, offsets, table):
        """All ids of the documents, an end id after each, and the number of ids of each."""
        starts, counts = K.pretokens(data, offsets, table)
        coded = K.piece_array(data, starts).dictionary_encode()
        words = [*map(self.ids, coded.dictionary.to_pylist()), self.end]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(itertools.chain.from_iterable(words), "<u4", int(lens.sum()))
        codes = np.insert(np.asarray(coded.indices), np.cumsum(counts), len(words) - 1)
        n = lens[codes]
        ids = flat[K.gather_runs(n, (np.cumsum(lens) - lens)[codes])]
        ends = np.cumsum(n)[np.cumsum(counts + 1) - 1]
        whole = self.with_added(data, offsets)
        if not whole:
            return ids, np.diff(ends, prepend=0)
        parts = np.split(ids, ends[:-1])
        for d in whole:
            text = data[offsets[d]:offsets[d + 1]].tobytes().decode()
            parts[d] = np.array(self.library.encode(text, add_special_tokens=False).ids + self.end, "<u4")
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def with_added(self, data, offsets) -> list[int]:
        """Documents that hold the string of an added token."""
        raw, found = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token, int(offsets[0]))
            while at >= 0:
                d = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[d + 1]
                if inside:
                    found.add(d)
                at = raw.find(token, int(offsets[d + 1]) if inside else at + 1)
        return sorted(found)


class FrameWriter:
    def __init__(self, sink, level: int):
        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.seek, self.index, self.open, self.size = [], [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        if self.size and self.size + len(ids) > FRAME_IDS:
            self.flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.seek), self.size, len(ids)))
        self.open.append(ids)
        self.size += len(ids)

    def flush(self) -> None:
        if not self.size:
            return
        plain = np.concatenate(self.open).astype("<u4").tobytes()
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        self.seek.append((len(packed), len(plain), checksum(plain)))
        self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.index, INDEX_ROW).tobytes()
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.seek, SEEK_ROW).tobytes()
        footer = struct.pack("<IBI", len(self.seek), 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Reads the trailing tables of a file, then single frames; checks every checksum."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("not a file with a seek table")
        table = size - 9 - n * SEEK_ROW.itemsize
        self.seek = np.frombuffer(self._at(table, n * SEEK_ROW.itemsize), SEEK_ROW)
        self.starts = np.append(0, np.cumsum(self.seek["packed"].astype(np.int64)))
        magic, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index")
        self.index = np.frombuffer(self._at(int(self.starts[-1]) + 8, length), INDEX_ROW)

    def _at(self, offset, n):
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        row = self.seek[k]
        plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(row["packed"])), max_output_size=int(row["plain"]))
        if len(plain) != row["plain"] or checksum(plain) != row["checksum"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, "<u4")

    def documents(self, wanted=None):
        """(doc_id, place among the file's ids, ids) of all documents or of those in ``wanted``."""
        first = np.cumsum(self.index["n_tokens"]) - self.index["n_tokens"]
        have, ids = -1, None
        for row, start in zip(self.index, first):
            doc_id = None if row["null"] else int(row["doc_id"])
            if wanted is not None and doc_id not in wanted:
                continue
            if have != row["frame"]:
                have, ids = int(row["frame"]), self.frame(int(row["frame"]))
            yield doc_id, int(start), ids[int(row["offset"]):int(row["offset"]) + int(row["n_tokens"])]


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


SHARD_SCHEMA = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def _write_shards(folder, spec, runs, end_id, level):
    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        where, base = open_fs(folder)
        final = f"{base}/shard-{shard:06d}.zst"
        attempt = f"{base}/_{shard:06d}-{context.taskAttemptId()}"
        encode, table = None, K.class_table(runs)
        sink = writer = None
        n_docs = n_tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encode = WordEncoder(spec, end_id)
                where.create_dir(base, recursive=True)
                sink = where.open_output_stream(attempt)
                writer = FrameWriter(sink, level)
            data, offsets = K.text_buffers(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for a, b in K.slices(offsets):
                ids, n = encode.documents(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], table)
                for d, part in zip(doc_ids[a:b], np.split(ids, np.cumsum(n)[:-1])):
                    writer.add(d, part)
                n_docs += b - a
                n_tokens += len(ids)
        if writer is not None:
            writer.close()
            n_bytes = sink.tell()
            sink.close()
            if where.get_file_info(final).is_file:  # another attempt of this task was first; its file is the same
                where.delete_file(attempt)
            else:
                where.move(attempt, final)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/shard-{shard:06d}.zst"],
                                              "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [n_bytes]})
    return run


def write_tokens(docs: DataFrame, spec: str, end_id: int, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", level: int = 3) -> DataFrame:
    """Write the files; returns one row per file with its first id's place among all ids.

    ``spec`` is the text of a byte-level tokenizer's JSON file; ids are those that the library gives for the
    whole text without special tokens around it: the string of an added token in a text is that token."""
    folder = folder or scratch_path(docs.sparkSession, "token-shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")  # many rows of one id are dealt to several shards
    dealt = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, "text")
    shards = written(dealt.mapInArrow(_write_shards(folder, spec, K.code_point_classes(), end_id, level), SHARD_SCHEMA), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def _read_shards(batches):
    for batch in batches:
        for row in batch.to_pylist():
            where, path = open_fs(row["path"])
            with where.open_input_file(path) as source:
                out, size = [], 0
                for doc_id, start, ids in FrameReader(source).documents():
                    out.append((doc_id, row["start"] + start, len(ids), ids.tobytes()))
                    size += len(ids)
                    if size > 1 << 20:
                        yield _read_batch(out)
                        out, size = [], 0
                if out:
                    yield _read_batch(out)


def _read_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                      names=["doc_id", "start", "n_tokens", "ids"])


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids from the files of ``write_tokens``."""
    n = max(1, shards.sparkSession.sparkContext.defaultParallelism)
    return (shards.select("path", "start").repartition(max(n, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
            .mapInArrow(_read_shards, READ_SCHEMA))


def read_documents(path: str, wanted: set) -> dict:
    """Ids of single documents of one file; only their frames are decompressed."""
    where, name = open_fs(path)
    with where.open_input_file(name) as source:
        return {d: ids for d, _, ids in FrameReader(source).documents(wanted)}


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
