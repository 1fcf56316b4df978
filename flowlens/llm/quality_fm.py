"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its words (hashed to ``BUCKETS``, log counts scaled to length 1), the
statistics of its structure (standardised on the training sample) and metadata columns
(one feature for each power of two, one for null). The score adds to the linear part the
low-rank interactions of all feature pairs in linear time: half the difference between the
square of the sums and the sum of the squares, for each factor. Weights are trained in numpy on
the driver from at most ``SAMPLE`` labelled documents, drawn by hash among the allowed ones; the
rest of the work is one pass of the tasks over bounded slices of whole texts.

Defined cases: null, empty and blank texts have no words and zero statistics and get a score all
the same; without labels every score is 0.5; several labels of a document count by their
mean (1 from 0.5 on), null labels not at all; repeated rows and null ids are scored row by row;
null metadata is a value of its own; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

BUCKETS = 1 << 14
SAMPLE = 3000
FACTORS = 8
EPOCHS = 8
LEAST_STEPS = 100  # small samples are read more often
STATS = ("log_words", "log_lines", "word_bytes", "line_words", "upper", "digits", "symbols", "marks", "bars", "blanks", "beyond_ascii",
         "repeated_words", "repeated_lines", "longest_line")
META_VALUES = 64


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(mask, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each document."""
    if not len(keys):
        return np.zeros(n, np.int64)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
    return np.bincount(d[new], minlength=n)


def structure(data, offsets, starts, ends, words, counts):
    """Statistics of each document (rows) in the order of STATS."""
    n = len(counts)
    size = np.maximum(np.diff(offsets), 1)
    n_words = np.maximum(counts, 1)
    doc = np.repeat(np.arange(n), counts)
    at_lines = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1][np.diff(offsets) > 0], at_lines + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[line_end - 1] == 10) if len(data) else line_end
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    full = line_end > line_start
    lines = np.bincount(line_doc[full], minlength=n)
    n_lines = np.maximum(lines, 1)
    hashes = K.span_hashes(data, line_start[full], line_end[full]) if full.any() else np.zeros(0, np.uint64)
    longest = np.zeros(n)
    np.maximum.at(longest, line_doc, line_end - line_start)
    symbols = np.isin(data, np.frombuffer(b"#*$%&<>@^~_=+\\{}[]", np.uint8))
    columns = (
        np.log1p(counts), np.log1p(lines), _per_doc(data > 32, offsets) / n_words, np.log1p(counts / n_lines),
        _per_doc((data >= 65) & (data <= 90), offsets) / size, _per_doc((data >= 48) & (data <= 57), offsets) / size,
        _per_doc(symbols, offsets) / n_words, _per_doc(np.isin(data, np.frombuffer(b"!?", np.uint8)), offsets) / n_words,
        _per_doc(data == 124, offsets) / n_words, _per_doc(data <= 32, offsets) / size, _per_doc(data >= 128, offsets) / size,
        1 - _distinct(words, doc, n) / n_words, 1 - _distinct(hashes, line_doc[full], n) / n_lines, np.log1p(longest))
    return np.where((counts > 0)[:, None], np.stack(columns, axis=1), 0.0)


def word_features(words: np.ndarray, counts: np.ndarray):
    """(row, bucket, value) with rows in order; the values of a row have length 1."""
    n = len(counts)
    key = np.repeat(np.arange(n, dtype=np.int64), counts) * BUCKETS + (words & np.uint64(BUCKETS - 1)).astype(np.int64)
    key, c = np.unique(key, return_counts=True)
    row = key // BUCKETS
    value = np.log1p(c)
    norm = np.sqrt(np.bincount(row, value * value, n))
    return row, key % BUCKETS, value / np.maximum(norm, 1e-12)[row]


def read_slices(batch: pa.RecordBatch, text_at: int):
    """(a, b, statistics, row, bucket, value) of bounded slices of a batch."""
    data, offsets = K.text_buffers(batch.column(text_at))
    for a, b in K.slices(offsets):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, counts = K.word_spans(part, at)
        words = K.span_hashes(K.ascii_lower(part), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        yield a, b, structure(part, at, starts, ends, words, counts), *word_features(words, counts)


def meta_value(values: pa.Array) -> np.ndarray:
    """Feature of a numeric column: 0 null, else 1 + the power of two of its size."""
    x = np.abs(np.asarray(pc.fill_null(pc.cast(values, pa.float64()), 0.0)))
    out = np.minimum(1 + np.log2(np.maximum(np.nan_to_num(x, posinf=1e300), 1)).astype(np.int64), META_VALUES - 1)
    return np.where(np.asarray(pc.is_null(values)), 0, out)


class Machine:
    """Parameters and the linear-time score. Features: words, then statistics, then metadata."""

    def __init__(self, n_meta: int, seed: int = 9):
        self.n = BUCKETS + len(STATS) + n_meta * META_VALUES
        self.bias = 0.0
        self.w = np.zeros(self.n)
        self.v = np.random.default_rng(seed).standard_normal((self.n, FACTORS)) * 0.05
        self.mean, self.scale = np.zeros(len(STATS)), np.ones(len(STATS))

    def features(self, stats, row, bucket, value, meta):
        """All features as (row, feature, value), rows in order; every row has some."""
        n = len(stats)
        s = np.clip((stats - self.mean) / self.scale, -4, 4)
        rows = np.concatenate([row, np.repeat(np.arange(n), len(STATS)), *(np.arange(n) for _ in meta)])
        at = np.concatenate([bucket, np.tile(BUCKETS + np.arange(len(STATS)), n),
                             *(BUCKETS + len(STATS) + k * META_VALUES + m for k, m in enumerate(meta))])
        x = np.concatenate([value, s.reshape(-1), *(np.ones(n) for _ in meta)])
        order = np.argsort(rows, kind="stable")
        return rows[order], at[order], x[order]

    def sums(self, rows, at, x):
        """Score before the sigmoid and the sums of each factor; one row of output for each row."""
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        vx = self.v[at] * x[:, None]
        total = np.add.reduceat(vx, first)
        pairs = 0.5 * ((total ** 2).sum(axis=1) - np.add.reduceat((vx ** 2).sum(axis=1), first))
        return self.bias + np.add.reduceat(self.w[at] * x, first) + pairs, total

    def score(self, stats, row, bucket, value, meta):
        y, _ = self.sums(*self.features(stats, row, bucket, value, meta))
        return 0.5 * (1 + np.tanh(0.5 * np.clip(y, -30, 30)))


def fit(stats, docs, labels, meta, seed: int = 9) -> Machine:
    """stats by document; docs: list of (buckets, values); labels 0 or 1; meta: arrays by column."""
    m = Machine(len(meta), seed)
    m.mean, m.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    share = np.clip(labels.mean(), 0.01, 0.99)
    m.bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    g_w, g_v, g_b = np.full(m.n, 1e-8), np.full(m.v.shape, 1e-8), 1e-8
    steps = -(-len(docs) // 128)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // max(steps, 1)))):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), 128):
            part = order[s:s + 128]
            row = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
            bucket = np.concatenate([docs[i][0] for i in part]).astype(np.int64)
            value = np.concatenate([docs[i][1] for i in part])
            rows, at, x = m.features(stats[part], row, bucket, value, [k[part] for k in meta])
            y, total = m.sums(rows, at, x)
            error = (0.5 * (1 + np.tanh(0.5 * np.clip(y, -30, 30))) - labels[part]) / len(part)
            e = (error[rows] * x)[:, None]
            d_w = np.bincount(at, e[:, 0], m.n) + 1e-5 * m.w
            d_v = np.zeros_like(m.v)
            np.add.at(d_v, at, e * (total[rows] - m.v[at] * x[:, None]))
            g_w += d_w ** 2
            g_v += d_v ** 2
            g_b += error.sum() ** 2
            m.w -= 0.1 * d_w / np.sqrt(g_w)
            m.v -= 0.05 * d_v / np.sqrt(g_v)
            m.bias -= 0.1 * error.sum() / np.sqrt(g_b)
    return m


def _collect(batches):
    """text, label, metadata -> features of the sampled documents."""
    for batch in batches:
        for a, b, stats, row, bucket, value in read_slices(batch, 0):
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v, t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(stats), pa.list_(pa.float64())), lists(bucket, pa.int32()), lists(value, pa.float64()), batch.column(1).slice(a, b - a),
                 pa.array(list(np.stack([meta_value(batch.column(i).slice(a, b - a)) for i in range(2, batch.num_columns)], axis=1))
                          if batch.num_columns > 2 else [[]] * (b - a), pa.list_(pa.int64()))],
                names=["stats", "buckets", "values", "label", "meta"])


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", meta_cols: tuple[str, ...] = ("n_chars",), seed: int = 9) -> Machine | None:
    """Train on a bounded sample of the allowed labelled documents; None without any."""
    lot = F.xxhash64(F.lit(seed), F.col("_id").cast("string"))
    chosen = (labels.where(allowed & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_label"))
              .orderBy(lot, "_id").limit(SAMPLE).withColumn("_label", (F.col("_label") >= 0.5).cast("int")))
    own = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), *(F.col(c).cast("double").alias(f"_meta{k}") for k, c in enumerate(meta_cols)))
    rows = own.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).drop("_doc", "_id")  # at most SAMPLE ids
    rows = rows.select("_text", "_label", *(f"_meta{k}" for k in range(len(meta_cols))))
    got = rows.mapInArrow(_collect, "stats array<double>, buckets array<int>, values array<double>, label int, meta array<long>").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["stats"], r["label"]))  # the order of tasks must not matter
    meta = np.array([r["meta"] for r in got], np.int64).reshape(len(got), -1)
    return fit(np.array([r["stats"] for r in got]), [(np.array(r["buckets"], np.int64), np.array(r["values"])) for r in got],
               np.array([r["label"] for r in got], float), list(meta.T), seed)


def _score(machine, n_meta):
    def run(batches):
        for batch in batches:
            for a, b, stats, row, bucket, value in read_slices(batch, 1):
                if machine is None:
                    score = np.full(b - a, 0.5)
                else:
                    meta = [meta_value(batch.column(2 + k).slice(a, b - a)) for k in range(n_meta)]
                    score = machine.score(stats, row, bucket, value, meta)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text",
          meta_cols: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 is likelier) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *(F.col(c).cast("double").alias(f"_meta{k}") for k, c in enumerate(meta_cols)))
    return rows.mapInArrow(_score(machine, len(meta_cols)), "doc_id long, score double")
