"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, gives every position a probability for
each language, and a document's probabilities are the means over all its bytes. Weights are trained
in numpy by backpropagation through time, on the driver, on a bounded sample: at most
``SAMPLE_DOCS`` documents a language with ``WINDOWS`` pieces of ``TRAIN_BYTES`` each, drawn by hash
from the labelled rows that the caller allows. Languages are those that the labels name.

All windows of a document are read (texts are never cut short); a task holds the windows of a
bounded slice of its texts. The model is a few thousand numbers and travels with the tasks.

Defined cases: a null text, an empty one or one without a letter is ``und`` with score 0; so is
every text if no row is labelled; rows are judged one by one, so repeated rows and null ids do no
harm; columns named lang_pred or score are replaced, all others pass through.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import textkernel as K

SAMPLE_DOCS = 300
WINDOWS = 4
TRAIN_BYTES = 64
READ_BYTES = 128   # window of a prediction
HIDDEN = 8
STEPS = 250
BATCH = 256
UNKNOWN = "und"
_PAD = 256
_BLOCK = 1024      # windows read at a time


def sample(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str, seed: int = 3) -> list[tuple[str, bytes]]:
    """(language, bytes) pieces of a bounded number of labelled documents."""
    rows = docs.where(allowed & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    text = F.col(text_col)
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 11) / F.lit(float(1 << 53))
    share = F.coalesce(*(F.when(F.col(lang_col) == lang, F.lit(min(1.0, 1.3 * SAMPLE_DOCS / n))) for lang, n in counts.items()))
    pieces = F.array(*(F.substring(text, (F.pmod(F.xxhash64(F.lit(k), F.length(text), lot), F.greatest(F.length(text) - TRAIN_BYTES // 2, F.lit(1))) + 1).cast("int"),
                                   F.lit(TRAIN_BYTES)) for k in range(WINDOWS)))
    drawn = (rows.where((F.length(text) > 0) & (lot < share)).select(F.col(lang_col).alias("lang"), lot.alias("lot"), pieces.alias("pieces"))
             .orderBy("lot", "lang", "pieces").limit(2 * SAMPLE_DOCS * len(counts)).collect())
    used: dict[str, int] = {}
    out = []
    for r in drawn:
        used[r["lang"]] = used.get(r["lang"], 0) + 1
        if used[r["lang"]] <= SAMPLE_DOCS:
            out += [(r["lang"], p.encode()[:TRAIN_BYTES]) for p in r["pieces"] if p]
    return out


def windows(data: np.ndarray, offsets: np.ndarray, width: int):
    """Matrix of byte numbers (256 where a window reaches beyond its document) and each row's document."""
    lens = np.diff(offsets)
    per_doc = -(-lens // width)
    doc = np.repeat(np.arange(len(lens)), per_doc)
    begin = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * width
    at = begin[:, None] + np.arange(width)
    inside = at < offsets[1:][doc][:, None]
    out = np.full(at.shape, _PAD, np.int16)
    out[inside] = data[at[inside]]
    return out, doc


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_network(n_langs: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    net = {"bytes": f(2, 3 * hidden, 257, scale=0.5), "state": f(2, 3 * hidden, hidden, scale=0.4),
           "out": f(n_langs, 2 * hidden, scale=0.3), "bias": np.zeros((n_langs, 1), np.float32)}
    _fix_pad(net["bytes"], hidden)
    return net


def _fix_pad(table, hidden):
    """Beyond a document the update gate is shut: the state stays."""
    table[:, :, _PAD] = 0
    table[:, hidden:2 * hidden, _PAD] = 30


def gradient(net, x: np.ndarray, labels: np.ndarray):
    """Loss and gradients of the mean cross entropy over positions; x: windows by positions."""
    h2, (n, t_max) = net["state"].shape[2], x.shape
    x = np.ascontiguousarray(x.T)
    order = np.stack([np.arange(t_max), np.arange(t_max)[::-1]])
    state = np.zeros((2, h2, n), np.float32)
    kept = []
    hs = np.empty((t_max, 2, h2, n), np.float32)
    for t in range(t_max):
        inputs = np.stack([net["bytes"][d][:, x[order[d, t]]] for d in range(2)])
        g = np.matmul(net["state"], state)
        rz = sigmoid(inputs[:, :2 * h2] + g[:, :2 * h2])
        r, z = rz[:, :h2], rz[:, h2:]
        c = np.tanh(inputs[:, 2 * h2:] + r * g[:, 2 * h2:])
        new = c + z * (state - c)
        kept.append((state, r, z, c, g[:, 2 * h2:]))
        state = new
        for d in range(2):
            hs[order[d, t], d] = new[d]
    flat = hs.reshape(t_max, 2 * h2, n)
    logits = np.matmul(net["out"], flat) + net["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    inside = (x != _PAD).astype(np.float32)[:, None, :]
    total = max(1.0, float(inside.sum()))
    truth = np.zeros((1, p.shape[1], n), np.float32)
    truth[0, labels, np.arange(n)] = 1
    loss = -float((np.log(np.maximum((p * truth).sum(axis=1, keepdims=True), 1e-12)) * inside).sum()) / total
    d_logits = (p - truth) * inside / total
    grads = {"out": np.einsum("tln,thn->lh", d_logits, flat, optimize=True), "bias": d_logits.sum(axis=(0, 2))[:, None],
             "state": np.zeros_like(net["state"])}
    d_hs = np.matmul(net["out"].T, d_logits).reshape(t_max, 2, h2, n)
    carried = np.zeros((2, h2, n), np.float32)
    d_inputs = np.empty((t_max, 2, 3 * h2, n), np.float32)
    for t in range(t_max - 1, -1, -1):
        before, r, z, c, gc = kept[t]
        dh = carried + np.stack([d_hs[order[d, t], d] for d in range(2)])
        d_c = dh * (1 - z) * (1 - c * c)
        d_z = dh * (before - c) * z * (1 - z)
        d_r = d_c * gc * r * (1 - r)
        d_g = np.concatenate([d_r, d_z, d_c * r], axis=1)
        grads["state"] += np.matmul(d_g, before.transpose(0, 2, 1))
        carried = dh * z + np.matmul(net["state"].transpose(0, 2, 1), d_g)
        for d in range(2):
            d_inputs[order[d, t], d] = np.concatenate([d_r[d], d_z[d], d_c[d]])
    where = x.reshape(-1)
    grads["bytes"] = np.stack([[np.bincount(where, row, 257) for row in d_inputs[:, d].transpose(1, 0, 2).reshape(3 * h2, -1)] for d in range(2)]).astype(np.float32)
    return loss, grads


def train(pieces: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5):
    """(languages, network) by Adam on batches of windows; languages in order."""
    langs = sorted({lang for lang, _ in pieces})
    if not langs:
        return [], None
    data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    offsets = np.append(0, np.cumsum([len(p) for _, p in pieces])).astype(np.int64)
    x, doc = windows(data, offsets, TRAIN_BYTES)
    y = np.array([langs.index(lang) for lang, _ in pieces])[doc]
    net = new_network(len(langs), hidden, seed)
    if len(langs) == 1:
        return langs, net
    rng = np.random.default_rng(seed)
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(w) for k, w in net.items()}
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(r, max(1, BATCH // len(langs))) for r in by_lang])  # languages weigh the same
        _, grads = gradient(net, x[rows], y[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        _fix_pad(net["bytes"], hidden)
    return langs, net


class Reader:
    """Forward passes only: gates as scaled tanh, all buffers reused."""

    def __init__(self, net, width: int = READ_BYTES):
        h = net["state"].shape[2]
        self.h, self.width = h, width
        half = np.ones(3 * h, np.float32)
        half[:2 * h] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.table = net["bytes"] * half[None, :, None]
        self.state = np.ascontiguousarray(net["state"] * 0.5)  # the last third times (1 + tanh) is r * g
        self.out, self.bias = net["out"], net["bias"]
        f = lambda *s: np.empty(s, np.float32)
        self.x, self.g, self.c, self.hs = f(2, 3 * h, _BLOCK), f(2, 3 * h, _BLOCK), f(2, h, _BLOCK), f(2, width, h, _BLOCK)

    def window_sums(self, x: np.ndarray) -> np.ndarray:
        """Sum over the positions of each window of the languages' probabilities."""
        n, h = len(x), self.h
        if n < _BLOCK:
            x = np.concatenate([x, np.full((_BLOCK - n, self.width), _PAD, np.int16)])
        x = np.ascontiguousarray(x.T).astype(np.intp)
        state = np.zeros((2, h, _BLOCK), np.float32)
        for t in range(self.width):
            for d, at in ((0, t), (1, self.width - 1 - t)):
                np.take(self.table[d], x[at], axis=1, out=self.x[d], mode="clip")
            np.matmul(self.state, state, out=self.g)
            gates, gate_g = self.x[:, :2 * h], self.g[:, :2 * h]
            gates += gate_g
            np.tanh(gates, out=gates)
            gates += 1
            c = np.multiply(gates[:, :h], self.g[:, 2 * h:], out=self.c)
            c += self.x[:, 2 * h:]
            np.tanh(c, out=c)
            state -= c
            state *= gates[:, h:]
            state *= 0.5
            state += c
            self.hs[0, t], self.hs[1, self.width - 1 - t] = state[0], state[1]
        logits = np.matmul(self.out[:, :h], self.hs[0])
        logits += np.matmul(self.out[:, h:], self.hs[1])
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        logits *= (x != _PAD)[:, None, :]
        return logits.sum(axis=0).T[:n]

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of every document (zeros for an empty one)."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.out)))
        if not len(data):
            return out
        x, doc = windows(data, offsets, self.width)
        for a in range(0, len(x), _BLOCK):
            np.add.at(out, doc[a:a + _BLOCK], self.window_sums(x[a:a + _BLOCK]))
        return out / np.maximum(np.diff(offsets), 1)[:, None]


def _predict(langs, net, text_at, letter_at, keep):
    def run(batches):
        reader = Reader(net) if net is not None else None
        names = pa.array([*langs, UNKNOWN])
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(text_at))
            letters = np.asarray(batch.column(letter_at))
            for a, b in K.slices(offsets, 2 << 20):
                if reader is None:
                    best, score = np.full(b - a, len(langs)), np.zeros(b - a)
                else:
                    p = reader.documents(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    ok = letters[a:b]
                    best = np.where(ok, p.argmax(axis=1), len(langs))
                    score = np.where(ok, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in keep), names.take(pa.array(best)), pa.array(score)],
                                                 names=[*(batch.schema.names[i] for i in keep), "lang_pred", "score"])
    return run


def identify(docs: DataFrame, langs: list[str], net, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) of every row with lang_pred and score."""
    own = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_lang_id_letter")
    rows = docs.select(*(F.col(c) for c in own), *([] if text_col in own else [F.col(text_col)]), letter)
    schema = StructType([*(docs.schema[c] for c in own), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_predict(langs, net, rows.columns.index(text_col), len(rows.columns) - 1, list(range(len(own)))), schema)
