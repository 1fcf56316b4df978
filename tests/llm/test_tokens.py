"""BPE by distinct words and seekable token files against the tokenizer libraries."""
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from flowlens.llm import bpe, token_output
from flowlens.llm import textkernel as K

RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "s", "t", "re", "ve", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "²", "é", "!", "…", "\u00a0", "\x1c", "\x85", "日", "😀", "\u200b", "\r\n", "D", "'T"]


def noise(n, most=14, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return bpe.encoder(bpe.load_ranks(RANKS))


def test_pretokens_equal_the_pattern():
    docs = noise(20_000)
    data, offsets = K.text_buffers(pa.array(docs))
    starts, counts = K.pretokens(data, offsets, K.class_table(K.code_point_classes()))
    ends = np.append(starts, len(data))
    pieces = [bytes(data[a:b]).decode() for a, b in zip(ends, ends[1:])]
    pattern, at = regex.compile(P.PATTERN), 0
    for text, k in zip(docs, counts):
        assert pieces[at:at + k] == pattern.findall(text)
        at += k


def check(rows, texts, library):
    want = sorted((d is None, d or 0, hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest(), len(library.encode_ordinary(t or ""))) for d, t in texts)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in rows)
    assert got == want


def test_encode_decode_equal_the_library(spark, library, odd_docs):
    texts = list(enumerate(noise(300, 60, seed=2))) + [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    check(bpe.digest(bpe.encode_and_decode(docs, RANKS, chunk_bytes=2000)).collect(), texts, library)
    check(bpe.digest(bpe.decode(bpe.encode(odd_docs, RANKS), RANKS)).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], library)
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def spec():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_files_hold_the_ids_in_order(spark):
    texts = list(enumerate(noise(400, 80, seed=3)))
    random.Random(4).shuffle(texts)
    shards = token_output.write_tokens(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), spec(), 2)
    rows = sorted(token_output.digest(token_output.read_tokens(shards)).collect(), key=lambda r: r.start)
    lib, at = Tokenizer.from_str(spec()), 0
    assert [r.doc_id for r in rows] == list(range(400))
    for r, (_, text) in zip(rows, sorted(texts)):
        ids = np.array(lib.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_odd_rows_and_an_empty_table(spark, odd_docs):
    rows = token_output.read_tokens(token_output.write_tokens(odd_docs, spec(), 2)).collect()
    assert len(rows) == odd_docs.count() and sum(r.n_tokens == 1 for r in rows) == 3
    # null ids first, then by id; every row has the library's ids and starts where the one before it ends
    lib, at = Tokenizer.from_str(spec()), 0
    rows = sorted(rows, key=lambda r: r.start)
    key = lambda d: (d is not None, d or 0)
    assert [r.doc_id for r in rows] == sorted((d.doc_id for d in odd_docs.collect()), key=key)
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    want = sorted((key(d.doc_id), lib.encode(d.text or "", add_special_tokens=False).ids + [2]) for d in odd_docs.collect())
    assert sorted((key(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert token_output.read_tokens(token_output.write_tokens(odd_docs.limit(0), spec(), 2)).count() == 0


def test_readers_open_only_the_frames_they_need(tmp_path):
    path = tmp_path / "x.zst"
    rng = np.random.default_rng(0)
    docs = {d: rng.integers(0, 50_000, 40_000).astype("<u4") for d in range(6)}
    with open(path, "wb") as f:
        writer = token_output.FrameWriter(f, 3)
        for d, ids in docs.items():
            writer.add(d, ids)
        writer.close()
    got = token_output.read_documents(str(path), {4})
    assert list(got) == [4] and (got[4] == docs[4]).all()
    import zstandard
    raw = path.read_bytes()
    plain = b"".join(x.tobytes() for x in docs.values())
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(len(plain)) == plain
    # the seek table of the public format: footer, then size, plain size and the low half of XXH64 of each frame
    import struct
    import xxhash
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert (flags, magic) == (0x80, 0x8F92EAB1)
    at = 0
    for k in range(n):
        packed, size, check = struct.unpack("<III", raw[len(raw) - 9 - 12 * (n - k):][:12])
        frame = zstandard.ZstdDecompressor().decompress(raw[at:at + packed])
        assert (len(frame), xxhash.xxh64_intdigest(frame) & 0xFFFFFFFF) == (size, check)
        at += packed
    damaged = bytearray(raw)
    damaged[100] ^= 255
    path.write_bytes(damaged)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_output.read_documents(str(path), {0})
    assert (token_output.read_documents(str(path), {4})[4] == docs[4]).all()


def test_added_tokens_have_the_ids_of_the_library(spark):
    parts = ["<|endoftext|>", "<|endoftext", "|>", *PARTS]
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(300)] + [(300, "a <|endoftext|> b"), (301, "<|endof"), (302, "text|>")]
    shards = token_output.write_tokens(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spec(), 2)
    lib, at = Tokenizer.from_str(spec()), 0
    rows = sorted(token_output.read_tokens(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == list(range(303))
    for r, (_, text) in zip(rows, texts):
        ids = lib.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, np.frombuffer(r.ids, "<u4").tolist()) == (at, ids)
        at += len(ids)
