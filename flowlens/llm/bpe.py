"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Tasks cut texts into pre-tokens and write them as chunks: the distinct pre-tokens of a
   chunk (its words) and, for every position, the number of the word there. The table is
   bucketed by chunk, so that later steps need not move the positions.
2. Words are exploded and dealt by their bytes. Equal words of all chunks meet in order in
   one task, which runs the merges once for each distinct word and returns the ids to the
   chunks, packed by chunk.
3. Each chunk joins its words' ids and reassembles the ids of its documents by position.

Decoding joins the table of token bytes, which has one row per rank of the vocabulary file
(its size is fixed, so it travels with the tasks), and concatenates by position.

A null text is an empty one; an empty text has no ids. Rows are never merged: repeated
rows and repeated or null ids give one result row each. Other columns are not read.
"""
from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import scratch_path
from . import textkernel as K

CHUNK_BYTES = 28 << 20  # text of one chunk; bounds a task's memory, a longer document is a chunk of its own
PACK_WORDS = 200_000  # words whose ids are packed at a time


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def public_pattern() -> str:
    from public_tokenizers import PATTERN

    return PATTERN


def encoder(ranks: dict[bytes, int], pattern: str | None = None):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern or public_pattern(), mergeable_ranks=ranks, special_tokens={})


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    v = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.T).tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    v = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(v.T).view("<u4").reshape(-1)


CHUNK_SCHEMA = "chunk long, ids array<long>, counts array<int>, words array<binary>, ranks binary, places binary"


def _cut_chunks(runs, chunk_bytes):
    def run(batches):
        from pyspark import TaskContext

        table = K.class_table(runs)
        number = TaskContext.get().partitionId() << 32
        ids, counts, pieces, size = [], [], [], 0

        def chunk():
            nonlocal number, size
            # words stand in byte order, places hold ranks by frequency: both compress well
            coded = pa.chunked_array(pieces or [pa.array([], pa.large_binary()).dictionary_encode()]).unify_dictionaries()
            at = np.concatenate([np.asarray(c.indices) for c in coded.chunks] or [np.zeros(0, np.int64)]).astype(np.int64)
            words = coded.chunk(0).dictionary
            by_bytes = np.asarray(pc.sort_indices(words)).astype(np.int64)
            place = np.empty(len(words), np.int64)
            place[by_bytes] = np.arange(len(words))
            order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            row = pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()),
                "ids": pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
                "counts": pa.array([np.concatenate(counts).astype(np.int32)], pa.list_(pa.int32())),
                "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pc.cast(words.take(pa.array(by_bytes)), pa.binary())),
                "ranks": pa.array([squeeze(place[order])], pa.binary()),
                "places": pa.array([squeeze(rank[at])], pa.binary())})
            number += 1
            ids.clear(), counts.clear(), pieces.clear()
            size = 0
            return row

        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for a, b in K.slices(offsets):
                part = data[offsets[a]:offsets[b]]
                if ids and size + len(part) > chunk_bytes:
                    yield chunk()
                starts, per_doc = K.pretokens(part, offsets[a:b + 1] - offsets[a], table)
                ids.append(batch.column(0).slice(a, b - a))
                counts.append(per_doc)
                pieces.append(K.piece_array(part, starts).dictionary_encode())
                size += len(part)
        if ids:
            yield chunk()
    return run


PACK_SCHEMA = "chunk long, words binary, lengths binary, ids binary"


def _encode_sorted(ranks, pattern):
    """Words in order -> packed ids by chunk; a distinct word is encoded once."""
    def run(batches):
        enc = encoder(ranks, pattern)
        chunk, place, word, ids = [], [], [], []
        last, last_ids = None, None

        def pack():
            c = np.concatenate(chunk)
            p = np.concatenate(place)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
            first = np.cumsum(lens) - lens
            code = np.concatenate(word)
            order = np.lexsort((p, c))
            cuts = np.flatnonzero(np.diff(c[order], prepend=c[order][0] - 1))
            out = []
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                o = order[a:b]
                n = lens[code[o]]
                out.append({"chunk": int(c[o[0]]), "words": squeeze(np.diff(p[o], prepend=0)), "lengths": squeeze(n),
                            "ids": squeeze(flat[K.gather_runs(n, first[code[o]])])})
            chunk.clear(), place.clear(), word.clear(), ids.clear()
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("words", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())]))

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(2))
            ends = np.asarray(runs.run_ends)
            codes = np.empty(len(ends), np.int64)
            for i, w in enumerate(runs.values.to_pylist()):
                if w != last:
                    last, last_ids = w, enc.encode_ordinary(w.decode("utf-8", "surrogateescape"))
                codes[i] = len(ids)
                ids.append(last_ids)
            chunk.append(np.asarray(batch.column(0)))
            place.append(np.asarray(batch.column(1)).astype(np.int64))
            word.append(np.repeat(codes, np.diff(ends, prepend=0)))
            n += batch.num_rows
            if n >= PACK_WORDS:
                yield pack()
                n = 0
        if n:
            yield pack()
    return run


ENCODED_SCHEMA = "doc_id long, n_tokens long, ids binary"


def _reassemble(batches):
    for batch in batches:
        for row in batch.to_pylist():
            n_words = int(row["n_words"])
            lens, first = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
            flat, at = [], 0
            for p in row["packs"] or []:
                words = np.cumsum(unsqueeze(p["words"]).astype(np.int64))
                n = unsqueeze(p["lengths"]).astype(np.int64)
                ids = unsqueeze(p["ids"])
                lens[words] = n
                first[words] = at + np.cumsum(n) - n
                flat.append(ids)
                at += len(ids)
            flat = np.concatenate(flat) if flat else np.zeros(0, "<u4")
            by_rank = unsqueeze(row["ranks"])
            lens, first = lens[by_rank], first[by_rank]
            places = unsqueeze(row["places"])
            ends = np.cumsum(np.asarray(row["counts"], np.int64))
            # documents by groups of bounded length
            a = 0
            while a < len(ends):
                begin = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, begin + 1_000_000, side="right")))
                part = places[begin:int(ends[b - 1])]
                n = lens[part]
                ids = flat[K.gather_runs(n, first[part])].astype("<u4")
                cut = np.append(0, np.cumsum(n))[np.append(begin, ends[a:b]) - begin]
                offsets = pa.py_buffer((cut * 4).astype(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["ids"][a:b], pa.int64()),
                    "n_tokens": pa.array(np.diff(cut), pa.int64()),
                    "ids": pc.cast(pa.Array.from_buffers(pa.large_binary(), b - a, [None, offsets, pa.py_buffer(ids)]), pa.binary())})
                a = b


def _joined(docs: DataFrame, ranks: dict[bytes, int], id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Chunks with the ids of their words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = rows.mapInArrow(_cut_chunks(K.code_point_classes(), chunk_bytes), CHUNK_SCHEMA)
    name, path = f"bpe_chunks_{uuid.uuid4().hex}", scratch_path(spark, "bpe-chunks")
    buckets = max(1, rows.rdd.getNumPartitions())
    cut.write.bucketBy(buckets, "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    chunks = spark.table(name)
    words = chunks.select("chunk", F.posexplode("words").alias("place", "word"))
    packs = (words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_sorted(ranks, public_pattern()), PACK_SCHEMA)
             .repartition(buckets, "chunk")  # as the chunks are bucketed, which then stay where they are
             .groupBy("chunk").agg(F.collect_list(F.struct("words", "lengths", "ids")).alias("packs")))
    return (chunks.select("chunk", "ids", "counts", F.size("words").alias("n_words"), "ranks", "places")
            .join(packs, "chunk", "left").select("ids", "counts", "n_words", "ranks", "places", "packs"))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Columns doc_id, n_tokens and ids (little-endian unsigned 32-bit) for every row of ``docs``."""
    return _joined(docs, load_ranks(ranks_path), id_col, text_col, chunk_bytes).mapInArrow(_reassemble, ENCODED_SCHEMA)


def _decode(ranks, ids_col, keep):
    tokens = sorted(ranks, key=ranks.get)
    top = max(ranks.values()) + 1

    def run(batches):
        lens = np.zeros(top, np.int64)
        lens[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
        table = np.frombuffer(b"".join(tokens), np.uint8)
        first = np.zeros(top, np.int64)
        n = np.array([len(t) for t in tokens], np.int64)
        first[[ranks[t] for t in tokens]] = np.cumsum(n) - n
        for batch in batches:
            data, offsets = K.text_buffers(pc.fill_null(batch.column(ids_col), b""))
            for a, b in K.slices(offsets):
                ids = data[offsets[a]:offsets[b]].view("<u4").astype(np.int64)
                n = lens[ids]
                out = table[K.gather_runs(n, first[ids])]
                cut = np.append(0, np.cumsum(n))[(offsets[a:b + 1] - offsets[a]) // 4]
                got = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in keep] + [pc.cast(got, pa.binary())], names=[*keep, "decoded"])
    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to the rows that ``encode`` returns."""
    keep = encoded.columns
    return encoded.mapInArrow(_decode(load_ranks(ranks_path), "ids", keep), StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def encode_and_decode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
                      chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``decode(encode(docs))`` in one pass of each task over its chunks."""
    ranks = load_ranks(ranks_path)
    back = _decode(ranks, "ids", ["doc_id", "n_tokens", "ids"])
    return _joined(docs, ranks, id_col, text_col, chunk_bytes).mapInArrow(
        lambda batches: back(_reassemble(batches)), f"{ENCODED_SCHEMA}, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """sha256 of ids and of decoded bytes in lowercase hex."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


