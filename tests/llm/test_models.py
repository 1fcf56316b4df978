"""Trained operators: gradients, identities, held-out accuracy, odd rows."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import lang_id, quality_fm, url_filter
from flowlens.llm import textkernel as K
from flowlens.llm.common import fold, read_table

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in lang_id.new_network(3, 4, 1).items()}
    x = rng.integers(0, 256, (5, 7)).astype(np.int16)
    x[0, 4:] = 256
    y = np.array([0, 1, 2, 1, 0])
    _, grads = lang_id.gradient(net, x, y)
    for name in net:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in net[name].shape)
            if name == "bytes":
                at = (at[0], at[1], int(x[rng.integers(1, 5), rng.integers(0, 7)]))
            old, step = net[name][at], 1e-4
            net[name][at] = old + step
            up, _ = lang_id.gradient(net, x, y)
            net[name][at] = old - step
            down, _ = lang_id.gradient(net, x, y)
            net[name][at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-5)


def test_reader_agrees_with_the_training_pass():
    net = lang_id.new_network(3, lang_id.HIDDEN, 2)
    data = np.frombuffer("ein Text, un texto, a text".encode(), np.uint8)
    reader = lang_id.Reader(net, 16)
    p = reader.documents(data, np.array([0, 10, 10, len(data)]))
    x, doc = lang_id.windows(data, np.array([0, 10, 10, len(data)]), 16)
    assert p[1].sum() == 0 and np.allclose(p[[0, 2]].sum(axis=1), 1, atol=1e-4)
    for row in range(len(x)):  # loss of a label is the mean of its negative log probabilities; here: of a single position
        one = np.full((1, 16), 256, np.int16)
        one[0, 0] = x[row, 0]
        loss, _ = lang_id.gradient(net, one, np.array([1]))
        assert reader.window_sums(one)[0, 1] == pytest.approx(np.exp(-loss), rel=1e-3)


def test_language_of_held_out_documents(spark, odd_docs):
    docs = read_table(spark, SMALL, "documents")
    model = lang_id.train(lang_id.sample(docs, fold("doc_id", 4) != 2, "doc_id", "text", "lang"))
    rows = lang_id.identify(docs, *model).where(fold("doc_id", 4) == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    odd = lang_id.identify(odd_docs.withColumn("score", F.lit("x")), *model)
    assert sorted(odd.columns) == sorted([*odd_docs.columns, "lang_pred", "score"])
    for r in odd.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and (r.score > 0) == (r.lang_pred != "und")
    assert lang_id.identify(odd_docs.limit(0), *model).count() == 0
    assert {r.lang_pred for r in lang_id.identify(odd_docs, *lang_id.train([])).collect()} == {"und"}


def test_pairs_by_sums_of_squares():
    m = quality_fm.Machine(1)
    rng = np.random.default_rng(1)
    m.w, m.v, m.bias = rng.standard_normal(m.n), rng.standard_normal(m.v.shape), 0.3
    rows, at, x = np.array([0, 0, 0, 1, 1]), np.array([5, 9, 70, 5, 8]), np.array([0.5, -1.0, 2.0, 1.0, 0.25])
    got, _ = m.sums(rows, at, x)
    for r in (0, 1):
        k = np.flatnonzero(rows == r)
        plain = 0.3 + sum(m.w[at[i]] * x[i] for i in k) + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in k for j in k if i < j)
        assert got[r] == pytest.approx(plain)


def test_statistics_of_structure():
    texts = ["Ab 12 #x!\n\nAb 12 #x!\nc|d", "", "é"]
    data, offsets = K.text_buffers(pa.array(texts))
    starts, ends, counts = K.word_spans(data, offsets)
    got = dict(zip(quality_fm.STATS, quality_fm.structure(data, offsets, starts, ends, K.span_hashes(data, starts, ends), counts).T))
    size = len(texts[0])
    assert got["upper"][0] == 2 / size and got["digits"][0] == 4 / size and got["symbols"][0] == 2 / 7 and got["bars"][0] == 1 / 7
    assert got["repeated_words"][0] == pytest.approx(1 - 4 / 7) and got["repeated_lines"][0] == pytest.approx(1 - 2 / 3)
    assert got["beyond_ascii"][2] == 1 and all(v[1] == 0 for v in got.values())


def test_quality_of_held_out_documents(spark, odd_docs):
    docs, labels = read_table(spark, MIDDLE, "documents"), read_table(spark, MIDDLE, "labels")
    machine = quality_fm.learn(docs, labels, fold("doc_id", 5) != 0)
    rows = quality_fm.score(docs, machine).join(labels, "doc_id").where(fold("doc_id", 5) == 0).collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.9
    odd = quality_fm.score(odd_docs, machine).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality_fm.score(odd_docs.limit(0), machine).count() == 0
    assert quality_fm.learn(odd_docs, labels.limit(0), fold("doc_id", 5) != 0) is None
    assert {r.score for r in quality_fm.score(odd_docs, None).collect()} == {0.5}


def test_segments_are_the_most_probable():
    import itertools
    import math
    words, total = {"cheap": 5, "pills": 7, "pill": 3, "s": 1, "the": 50, "he": 20, "art": 4, "heart": 9, "t": 2}, 101

    def score(parts):
        return sum(math.log(words[w] / total) if w in words else math.log(10 / total) - len(w) * math.log(10) for w in parts)

    for piece in ("cheappills", "theheart", "thart", "zqx", "pillss"):
        every = [[piece[a:b] for a, b in zip((0, *cut), (*cut, len(piece)))] for n in range(len(piece)) for cut in itertools.combinations(range(1, len(piece)), n)]
        assert score(url_filter.segment(piece, words, total)) == pytest.approx(max(map(score, every)))


def test_urls(spark):
    rows = [(1, None, None), (None, "nothing", "<p>a b"), (2, "HTTP://CheapPills.Example.COM/De/x?y#z", None), (2, "HTTP://CheapPills.Example.COM/De/x?y#z", ""),
            (3, "http://NET", ""), (4, "https://a.net/", ""), (5, "x://y://z.org/fr/?q", ""), (6, "h://b.example.net/en/1", "<script>poker</script>word word"),
            (7, "h://sub.org/fr/", ""), (8, "h://notorg/fr/", ""), (9, "h://example.com/de/7#a", ""), (10, "h://example.net/e", "")]
    rows += [(100 + i, f"h://good{i}.com/words/{i}", "good words") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit(1))
    got = {(r.page_id or 0): (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(pages).collect()}
    assert got[2] == ("cheappills.example.com", "/De/x", None, "block")
    assert got[1] == ("", "", None, "allow") and got[0] == ("", "", None, "allow")
    assert got[3] == ("net", "", None, "allow") and got[4] == ("a.net", "/", "net/", "block")
    assert got[5][:2] == ("y:", "//z.org/fr/") and got[6][2:] == ("example.net/en/", "allow") and got[7][2:] == ("org/fr/", "allow")
    assert got[8][2] is None and got[9][2:] == ("example.com/de/", "block") and got[10][2:] == ("net/", "block")
    assert all(got[100 + i][3] == "allow" for i in range(40))
    assert url_filter.verdicts(pages).count() == len(rows) and url_filter.verdicts(pages.limit(0)).count() == 0
