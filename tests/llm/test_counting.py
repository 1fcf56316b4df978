"""Phrases, token counts and the prefix trie against brute force and the library."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlens.llm import collocations, prefix_trie, token_counts
from flowlens.llm.queries import vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_by_hand(rows, least, cover, top):
    """lang -> rows of the report, straight from its definition with Python integers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, counts in f.items():
        found = []
        strong = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        for p, a in strong.items():
            if any(100 * b >= cover * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in strong.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n[lang], -score)
    return out


def some_texts(seed, count):
    rng = random.Random(seed)
    words = "of the new york city Deep learning model naïve café x 日本 a".split()
    rows = []
    for _ in range(count):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        text = "".join(rng.choice(".,;:!?\n\r\x0b\t") if c == " " and rng.random() < 0.1 else c for c in text)
        if rng.random() < 0.4:
            text += " New York City  hall"
        rows.append((rng.choice(("en", "fr", None, "und", "")), text))
    return [*rows, ("en", None), ("en", ""), (None, None), ("fr", "...\n!!")] + [("en", "big apple big apple")] * 5


def collect(spark, rows, least, cover, top):
    docs = spark.createDataFrame([(i, t, la, "clash") for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string")
    got = collocations.collocations(docs.repartition(4), least, cover, top).collect()
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}


@pytest.mark.parametrize("least,cover,top", [(5, 100, 2000), (3, 60, 10)])
def test_collocations(spark, least, cover, top):
    rows = some_texts(least, 250)
    want = phrases_by_hand(rows, least, cover, top)
    assert len(want) > 20
    assert collect(spark, rows, least, cover, top) == want


def test_spilled_and_burst_tries_merge_to_the_same(spark, monkeypatch):
    rows = some_texts(9, 200)
    monkeypatch.setattr(collocations, "MOST_PHRASES", 40)
    monkeypatch.setattr(collocations, "MOST_HASHES", 20)
    monkeypatch.setattr(collocations.HatTrie.__init__, "__defaults__", (3,))
    assert collect(spark, rows, 4, 100, 2000) == phrases_by_hand(rows, 4, 100, 2000)


def test_a_full_bit_map_changes_nothing(spark, monkeypatch):
    rows = some_texts(10, 100)
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    assert collect(spark, rows, 4, 100, 2000) == phrases_by_hand(rows, 4, 100, 2000)


def test_hat_trie_counts_tuples():
    rng = np.random.default_rng(1)
    trie, want = collocations.HatTrie(burst=4), Counter()
    for _ in range(40):
        rows = rng.integers(0, 4, (30, int(rng.integers(1, 6))))
        trie.add(rows, np.ones(len(rows), np.int64))
        want.update(map(tuple, rows.tolist()))
        assert len(trie) == len(want)
    got = Counter()
    for path, n in trie.spill(0):
        assert path not in got
        got[path] = n
    assert got == want and len(trie) == 0


def test_collocations_of_nothing(spark, odd_docs):
    assert collocations.collocations(odd_docs.limit(0)).count() == 0
    assert collocations.collocations(odd_docs, least=2).count() > 0


@pytest.fixture(scope="module")
def word_file():
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def odd_texts():
    rng = random.Random(3)
    alphabet = "abcdehilmnorstvwXYZ   \n\t'''0123!?.,-=é日😀́İΣς\x00\x1c <|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice(small) for _ in range(rng.randrange(1, 70))) for small in ("ab", "aaaaa!'h", "'svelr d") for _ in range(300)]
    texts += ["".join(chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(30)) for _ in range(500)]
    return texts + ["", "'", "'r", "'ve'll're'd'r'v'l 've", "a<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|>" * 3, "e<|endoftext|>́", "don't 'Tis 'RE", "x" * 20_000, "=" * 3_000]


def test_token_counts_equal_the_library(spark, word_file, library):
    texts = [*odd_texts(), None]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, word_file).collect()}
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == {i: (len((t or "").encode()), len(w.ids)) for i, (t, w) in enumerate(zip(texts, want))}


def test_long_texts_and_few_states(spark, word_file, library, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 500)
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    counter = token_counts.TextCounter(token_counts.compile_tables(word_file))
    whole = " ".join(odd_texts()[:200])
    pieces = list(token_counts.cut_long(whole, 500))
    assert "".join(pieces) == whole and len(pieces) > 5
    assert sum(int(counter.count([p])[0]) for p in pieces) == len(library.encode(whole, add_special_tokens=False).ids)


def test_chunks_compose_to_the_plain_reading():
    step, mark, _ = token_counts.splitter()
    rng = np.random.default_rng(0)
    for n in (1, 7, 100, 1000):
        kinds = np.append(rng.integers(0, step.shape[1], n), token_counts.BLANK).astype(np.uint8)
        want, state = set(), 0
        for i, k in enumerate(kinds):
            want |= ({i} if mark[state, k] & 1 else set()) | ({i - 1} if mark[state, k] & 2 else set())
            state = step[state, k]
        for lanes in (1, 3, 64, 5000):
            assert set(token_counts.split_marks(kinds, step, mark, lanes).tolist()) == want


def test_other_tokenizer_files_are_refused(word_file):
    with pytest.raises(ValueError):
        token_counts.compile_tables(word_file.replace("Lowercase", "NFD"))


def test_token_counts_of_odd_rows(spark, odd_docs, word_file):
    rows = token_counts.count_tokens(odd_docs, word_file).collect()
    assert len(rows) == odd_docs.count() and sorted(r.n_tokens for r in rows)[:4] == [0, 0, 0, 0]
    assert token_counts.count_tokens(odd_docs.limit(0), word_file).count() == 0


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sign = hashlib.md5(("%016X" % len(role.encode()) + role + text).encode()).digest()
            own[c].append((turn is not None, turn or 0, sign, (role, text)))
    own = {c: [t[-1] for t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if full[c] == p).encode()).hexdigest()) for p, m in members.items())


def some_conversations(seed, count, shared=0):
    rng = random.Random(seed)
    rows = []
    start = [("user" if k % 2 else "bot", f"common turn {k} é") for k in range(shared)]
    for c in range(-20, count):
        turns = start[:rng.randrange(shared + 1)] if shared and rng.random() < 0.7 else []
        turns = turns + [(rng.choice(("user", "bot", None)), rng.choice(("hi", "yes", "no", "", None, "日本"))) for _ in range(rng.randrange(0, 6))]
        rows += [(c, None if k == 0 and rng.random() < 0.3 else k, *t) for k, t in enumerate(turns)]
    rows += [rows[3]] * 2 + [(None, 1, "user", "lost"), (7_000_000_000, 0, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,count,shared,capacity", [(1, 150, 0, 1024), (2, 200, 12, 20), (3, 60, 40, 3)])
def test_prefix_trie(spark, seed, count, shared, capacity):
    rows = some_conversations(seed, count, shared)
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(4)
    got = prefix_trie.prefix_trie(turns, capacity).collect()
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0, *r[3:])
    assert sorted(map(tuple, got), key=key) == sorted(trie_by_hand(rows), key=key)


def test_ends_in_segments_and_no_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    rows = [(5 * c, 0, "user", "same") for c in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = prefix_trie.prefix_trie(turns).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(trie_by_hand(rows), key=lambda r: r[1])
    assert prefix_trie.prefix_trie(turns.limit(0)).count() == 0
