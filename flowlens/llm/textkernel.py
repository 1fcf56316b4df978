"""Vectorised text kernels over Arrow buffers: word spans, 64-bit word hashes, BPE pre-tokens.

All functions take the concatenated UTF-8 bytes of a slice of documents and the byte
offsets of the documents in it; callers cut batches into bounded slices first.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null counts as empty."""
    a = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges [a, b) of at most ``most`` bytes each; one longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Byte starts and ends of all words, and the number of words of each document."""
    n = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(n, np.int64)
    ink = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True  # a document border also ends a word
    first = first[:-1]
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | first[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans from prefix sums, finalised with the length.

    A span's sum is divided by the power at its start (an odd base has an inverse), so equal
    bytes have equal hashes wherever they stand."""
    n = len(data)
    with np.errstate(over="ignore"):
        table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * _powers(_P, n)[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(_P_INVERSE, n)[starts]
        return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int):
    """Hashes of all runs of ``width`` words in each document (all its words if fewer), and
    how many each document has (0 for one without words)."""
    per_doc = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    first_word = np.cumsum(counts) - counts
    first = np.repeat(first_word, per_doc) + np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    have = np.repeat(np.minimum(counts, width), per_doc)
    with np.errstate(over="ignore"):
        h = np.full(len(first), np.uint64(0x51ED270B9F652295))
        last = max(len(words) - 1, 0)
        for k in range(width):
            at = words[np.minimum(first + k, last)] if len(words) else np.zeros(0, np.uint64)
            h = np.where(have > k, mix64(h * np.uint64(0x9FB21C651E98DF25) + at), h)
        h ^= have.astype(np.uint64)
    return h, per_doc


def code_point_classes() -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal class over all code points: (first code point, class); 1 letter,
    2 number, 3 white space, 0 other. Built from Unicode properties on the driver."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            table[m.start():m.end()] = k
    at = np.flatnonzero(np.diff(table, prepend=255))
    return at, table[at]


def class_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at, kind = runs
    return np.repeat(kind, np.diff(np.append(at, 0x110000)))


def pretokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Byte starts of the pre-tokens (the pieces that byte-level BPE merges never cross) and
    how many each document has. The pieces of a document cover it without gaps."""
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    size = np.ones(n, np.uint8)
    size += cp >= 0x80
    size += cp >= 0x800
    size += cp >= 0x10000
    size[(cp >= 0xDC80) & (cp <= 0xDCFF)] = 1  # an invalid byte
    at = np.empty(n + 1, np.int64)
    at[0] = 0
    np.cumsum(size, out=at[1:])
    k = table[cp]
    blank, space = k == 3, cp == 32
    border = np.zeros(n + 1, bool)
    border[np.searchsorted(at, offsets)] = True
    border = border[:n]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(k[1:], k[:-1], out=change[1:])
    change |= border
    start = change.copy()
    # one plain space before letters, numbers or signs belongs to them
    start[1:] &= ~(~blank[1:] & space[:-1] & ~border[1:])
    # the last blank of a run that other characters follow is a piece of its own or joins them
    start[:-1] |= blank[:-1] & ~blank[1:] & ~border[1:]
    for p in np.flatnonzero((cp == 39) & start):
        tail = cp[p + 1:p + 3]
        if border[p + 1:p + 2].any() or not len(tail):
            continue
        one = chr(tail[0])
        two = one + chr(tail[1]) if len(tail) > 1 and not border[p + 2] else ""
        length = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if length:
            start[p + 1] = False
            if p + 1 + length < n:
                start[p + 1 + length] = True
    starts = at[np.flatnonzero(start)]
    return starts, np.diff(np.searchsorted(starts, offsets))


def piece_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces as an Arrow binary array over the same bytes."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    if not len(starts):
        return pa.array([], pa.large_binary())
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def gather_runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
