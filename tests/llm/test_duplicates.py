"""Joins and deduplication against brute force."""
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import components, embedding_dedup, jaccard_join, line_dedup
from flowlens.llm.common import written
from flowlens.session import DROPPED

from .conftest import sentence


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components_of_random_graphs(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(-5, k) for k in range(500, 560)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {n for a, b in edges if a != b for n in (a, b)}
    assert got == classes(used, [e for e in edges if e[0] in used and e[1] in used])


def near_copies(seed=1):
    rng = random.Random(seed)
    docs = []
    for _ in range(25):
        base = sentence(rng, rng.choice((3, 6, 9, 15, 30, 80, 200))).split()
        for _ in range(rng.choice((1, 2, 5))):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 2))):
                words[rng.randrange(len(words))] = "edited" + str(rng.randrange(99))
            docs.append(" ".join(words).upper() if rng.random() < 0.2 else "\t".join(words))
    passage = sentence(rng, 60)
    docs += [sentence(rng, rng.choice((10, 100))) + " " + passage for _ in range(12)]
    return docs


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_jaccard_join(spark):
    docs = near_copies() + ["", None, " \n"]
    sets = {i: shingles(t) for i, t in enumerate(docs)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(sets, links)
    assert len(links) > 30
    rows = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), want[i]) for i in sets}


def test_subsets_and_lists_meet_every_link():
    """Whatever the boundary, linked sets share a key whose places may link."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 60, 2).astype(np.uint64)]))
        if 180 * len(np.intersect1d(a, b)) < 80 * (len(a) + len(b)):
            continue
        for boundary in (0, 8, 24, 64):
            x, y = (jaccard_join.set_keys(s, 80, boundary) for s in (a, b))
            common, i, j = np.intersect1d(x[0], y[0], return_indices=True)
            pack = lambda s, k, at: (np.int64(len(s)) << 32) | (k[1][at].astype(np.int64) << 2) | k[2][at]
            same = len(a) == len(b) and (a == b).all()
            assert same or jaccard_join.may_link(pack(a, x, i), pack(b, y, j), 80).any(), (len(a), len(b), boundary)


def test_lists_lose_no_link_between_components(spark):
    """A group of near copies of several sizes: every link between components is met, however far the sizes prune."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(1, 1 << 60, 60).astype(np.uint64))
    sets = {}
    for i in range(70):
        kept = base[rng.random(len(base)) < rng.choice((0.8, 0.9, 0.97))]
        sets[i + 1] = np.unique(np.concatenate([kept, rng.integers(1, 1 << 60, int(rng.integers(0, 8))).astype(np.uint64)]))
    links = {(a, b) for a in sets for b in sets if a < b and 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))}
    component = classes(range(1, 31), [p for p in links if max(p) <= 30])
    done = sorted(links)[::9]
    of = lambda node: component.get(node, node)
    for boundary in (0, 50):
        entries = [(int(k), node, int(len(s)) << 32 | int(at) << 2 | 1)
                   for node, s in sets.items() for k, at, c in zip(*jaccard_join.set_keys(s, 80, boundary)) if c == 1]
        got = jaccard_join.token_pairs(spark.createDataFrame(entries, "key long, node long, pack long"),
                                       spark.createDataFrame(sorted(component.items()), "node long, component long"),
                                       spark.createDataFrame(done, "a long, b long"), 80, boundary).collect()
        want = {(a, b) for a, b in links if of(a) != of(b) and (a, b) not in done and max(len(sets[a]), len(sets[b])) > boundary}
        assert len(want) > 20 and len(got) == len(set(got))
        assert want <= {(r.a, r.b) for r in got}
        assert all(of(r.a) != of(r.b) and (r.a, r.b) not in done for r in got)


def test_one_of_each_class_stays(spark, odd_docs):
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)]
    assert jaccard_join.keep_one(odd_docs.limit(0)).count() == 0


def test_one_of_each_class_stays_with_repeated_and_null_ids(spark):
    rng = random.Random(8)
    a, b = sentence(rng, 60), sentence(rng, 60)
    near_a, near_b = a + " more", "other " + b
    rows = [(1, a), (2, near_a), (2, sentence(rng, 40)), (3, sentence(rng, 40)), (3, near_a.upper()), (None, near_b), (None, b), (None, sentence(rng, 30)),
            (4, ""), (4, None), (5, "x y"), (5, "x  y"), (5, "x y"), (None, None), (None, None), (6, near_b), (1, a)]
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = classes(range(len(rows)), links)
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = [(r.doc_id, frozenset(shingles(r.text))) for r in kept]
    # one row of every class of sets, under its smallest id (null last); rows without a set once an id and text
    want = {}
    for i, (d, t) in enumerate(rows):
        k = group[i] if sets[i] else (d, t)
        want[k] = min(want.get(k, (True, 0)), (d is None, d or 0))
    assert len(kept) == len(want)
    assert sorted((d is None, d or 0) for d, _ in got) == sorted(want.values())
    assert (2, frozenset(shingles(rows[2][1]))) in got and (3, frozenset(shingles(rows[3][1]))) in got


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    v = np.concatenate([base, base[:20] * 3, base[:30] + 0.2 * rng.standard_normal((30, 24)), base[:1] + 0.05 * rng.standard_normal((40, 24))])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23),
           (905, [float("inf")] + [1.0] * 23), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    links = [(i, j) for i in range(len(v)) for j in range(i) if cos[i, j] >= 0.95] + [(906, 907)]
    want = classes([*range(len(v)), *(b[0] for b in bad)], links)
    n = {k: 0 for k in want}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    old, embedding_dedup.TILE = embedding_dedup.TILE, 16
    try:
        got = embedding_dedup.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()
    finally:
        embedding_dedup.TILE = old
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (n[k], want[k], want[k] == k) for k in want}
    again = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(again).collect()) == [
        (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]
    assert embedding_dedup.near_duplicates(again.limit(0)).count() == 0


def test_tiles_are_dealt_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(24) + 0.05 * rng.standard_normal((640, 24))  # one group: every tile is near every other
    rows, write = {}, embedding_dedup.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(embedding_dedup, "written", counted)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()))
    assert {r.component_id for r in got} == {0}
    blocks = 1.5 * spark.sparkContext.defaultParallelism + 1
    # a pair of blocks returns two rows a vector at most; a pair of tiles would return as many
    assert rows["vector-links"] <= 2 * len(v) * (blocks + 1) < 2 * len(v) * 40


def test_written_tables_leave_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    kept = lambda: sum(len(list(Path(d).rglob("shuffle_*.data"))) for d in folders)
    before, setting = kept(), spark.conf.get(DROPPED, None)
    out = written(spark.range(1000).repartition(5), "dealt")
    assert kept() == before and spark.conf.get(DROPPED, None) == setting
    assert out.count() == 1000


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_fuzzy_lines(spark):
    """Whole documents against all pairs of lines by edit distance in characters, without any filter."""
    import re
    rng = random.Random(5)
    pool = [sentence(rng, rng.choice((1, 4, 30, 60))) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(pool)
            if rng.random() < 0.4:
                words = line.split()
                words.insert(rng.randrange(len(words) + 1), rng.choice(("the", "alphax", "of")))
                line = " ".join(words)
            lines.append(line.title() + "!" if rng.random() < 0.2 else line)
        docs.append((i, "\n".join(lines)))
    places = [(d, k, line) for d, t in docs for k, line in enumerate(t.split("\n"))]
    normal = {p[:2]: re.sub(r"[^a-z0-9]+", " ", p[2].lower()).strip() for p in places}
    texts = sorted(set(normal.values()))
    links = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1:] if edit_distance(a, b) <= max(len(a), len(b)) // 10]
    assert len(links) > 20
    group = classes(texts, links)
    first, want = {}, {}
    for d, k, line in places:
        if first.setdefault(group[normal[d, k]], (d, k)) == (d, k):
            want.setdefault(d, []).append(line)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in got} == {d: "\n".join(want.get(d, [])) for d, _ in docs}
    assert sum(r.n_removed for r in got) == len(places) - sum(map(len, want.values()))


def test_lines_of_odd_rows(spark, odd_docs):
    rows = line_dedup.dedup_lines(odd_docs)
    assert rows.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    got = [((r.doc_id or 0), r.text if r.text is None else r.text[:12], r.n_removed) for r in rows.collect() if r.doc_id != 4]
    assert [g for g in got if g[0] == 1] == [(1, "four", 1), (1, "four", 1)]  # a null id comes first
    assert rows.count() == odd_docs.count() and line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


def kept_lines(spark, lines):
    """Lines (one document each) of which something stays, and those that stay by brute force over edit distances of characters."""
    texts = sorted(set(lines))
    links = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1:]
             if abs(len(a) - len(b)) <= max(len(a), len(b)) // 10 and edit_distance(a, b) <= max(len(a), len(b)) // 10]
    group = classes(texts, links)
    first = {}
    for line in lines:
        first.setdefault(group[line], line)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    return sorted(r.text for r in line_dedup.dedup_lines(docs).collect() if r.text), sorted(first.values()), links


def test_short_lines_are_compared_by_characters(spark):
    rng = random.Random(11)
    lines = ["page 12 of 30", "page 13 of 30", "copyright acme inc", "copyright acmf inc", "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸", "一二三四五六七八九十甲乙丙丁戊己庚辛壬申", "abc", "abd"]
    for _ in range(40):
        base = sentence(rng, rng.randrange(1, 9))[:59]
        for _ in range(3):
            chars = list(base)
            for _ in range(rng.randrange(0, len(base) // 10 + 2)):
                at = rng.randrange(len(chars))
                rng.choice((lambda: chars.pop(at), lambda: chars.insert(at, "q"), lambda: chars.__setitem__(at, "w")))()
            lines.append(" ".join("".join(chars).split()))
    lines = [x for x in lines if 0 < len(x) < line_dedup.SHORT]
    got, want, links = kept_lines(spark, lines)
    assert got == want and len(links) > 40


def test_lines_with_edited_words_are_found(spark):
    rng = random.Random(12)
    lines = []
    for _ in range(40):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(rng.choice((12, 15, 25, 45, 80)))]
        lines.append(" ".join(words))
        for share in (0, 0.05):
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, int(share * len(words)))):
                copy[at] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in copy[at])
            lines.append(" ".join(copy))
    for size in (70, 150):  # a script without blanks
        line = [chr(0x4E00 + rng.randrange(20_000)) for _ in range(size)]
        lines += ["".join(line), "".join(line[:30] + ["字"] + line[31:])]
    got, want, links = kept_lines(spark, lines)
    assert got == want and len(links) > 80


def test_lines_with_edits_in_every_passage_are_found(spark):
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = []
    for size in (60, 64, 71, 72, 99, 150, 401, 640):
        base = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(size))[:size].strip().ljust(size, "e")
        changed, shorter, longer = list(base), list(base), list(base)
        for k, at in enumerate(range(size - 5, 4, -10)[:size // 10]):  # no ten letters in a row stay
            changed[at] = "0"
            if k < len(base) // 10 and base[at - 1] != " " and base[at + 1] != " ":
                del shorter[at]
            if k < len(base) // 10:
                longer.insert(at, "1")
        lines += [base, *("".join(x) for x in (changed, shorter, longer))]
    got, want, links = kept_lines(spark, lines)
    assert got == want and len(links) > 20


@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.95])
def test_pieces_miss_no_pair(similarity):
    rng = random.Random(14)
    pairs, lines = [], []
    for size in (60, 61, 75, 90, 200, 333):
        for _ in range(20):
            a = [rng.choice("abcd") for _ in range(size)]
            b, step = list(a), size // (line_dedup.edits(size, similarity) + 1)
            for k in range(line_dedup.edits(size, similarity)):  # spread as evenly as can be, in either direction
                rng.choice((lambda at: b.pop(at), lambda at: b.insert(at, "x"), lambda at: b.__setitem__(at, "y")))(min(k * step + step // 2, len(b) - 1))
            pairs.append((len(lines), len(lines) + 1))
            lines += ["".join(a), "".join(b)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(range(len(lines))), pa.array(lines)], names=["node", "component", "line"])
    cut, whole = {}, {}
    for rows in line_dedup._piece_rows(similarity, line_dedup.piece_size(similarity))([batch]):
        for r in rows.to_pylist():
            (whole if r["piece"] < 0 else cut).setdefault(r["node"], []).append(r)
    for a, b in pairs:
        if edit_distance(lines[a], lines[b]) <= line_dedup.edits(max(len(lines[a]), len(lines[b])), similarity):
            x, y = sorted((a, b), key=lambda i: len(lines[i]))
            longer = len(lines[y]) - len(lines[x])
            assert any(p["key"] == w["key"] and abs(w["at"] - p["at"]) <= p["piece"] and abs(w["at"] - p["at"] - longer) <= p["rest"]
                       for p in cut[x] for w in whole[y]), (lines[x], lines[y])


def test_pieces_of_lines_that_share_none_are_not_written(spark, monkeypatch):
    rng = random.Random(15)
    own = ["".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(size)) for size in (60, 75, 120, 300)]
    base = "".join(rng.choice("abcdefgh") for _ in range(90))
    near = [base, *(base[:k] + "z" + base[k + 1:] for k in range(0, 90, 3))]
    nodes = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(own + near)], "node long, line string, size int")
    sizes, write = {}, line_dedup.written

    def counted(df, name):
        out = write(df, name)
        sizes[name] = sizes.get(name, 0) + out.where(f"node < {len(own)}").count() if "piece" in out.columns else 0
        return out
    monkeypatch.setattr(line_dedup, "written", counted)
    groups = spark.createDataFrame([(len(own) + i, len(own)) for i in range(12)], "node long, component long")
    found = []
    for few in (0, 32, 10**6):
        monkeypatch.setattr(line_dedup, "FEW", few, raising=False)
        found.append({(r.a, r.b) for r in line_dedup.line_pieces(nodes, groups).collect()})
    ids, group = range(len(own), len(own + near)), lambda i: min(i, len(own)) if i < len(own) + 12 else i
    # all near lines of different groups are two edits apart at most
    assert found[0] == found[1] == found[2] == {(a, b) for a in ids for b in ids if a < b and group(a) != group(b)}
    assert not any(sizes.values()), sizes


def test_slices_of_pieces_hold_every_piece_once(spark, monkeypatch):
    rng = random.Random(16)
    base = ["".join(rng.choice("abcd") for _ in range(size)) for size in (60, 95, 210)]
    lines = [x for b in base for x in (b, b[:20] + "zz" + b[20:], b[:30] + "q" + b[31:])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(range(len(lines))), pa.array(lines)], names=["node", "component", "line"])
    length = line_dedup.piece_size(0.9)
    rows = lambda *part: [tuple(r.values()) for b in line_dedup._piece_rows(0.9, length, *part)([batch]) for r in b.to_pylist()]
    parts = [rows(4, k) for k in range(4)]
    assert all(parts) and sorted(sum(parts, [])) == sorted(rows())
    nodes = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "node long, line string, size int")
    groups = spark.createDataFrame([], "node long, component long")
    found = []
    for slices, held, few in ((1, 10**6, 10**6), (3, 10**6, 2), (2, 3, 32), (2, 1, 1)):  # keys of more rows than a task holds too
        for name, value in (("SLICES", slices), ("HELD", held), ("FEW", few)):
            monkeypatch.setattr(line_dedup, name, value)
        found.append({(r.a, r.b) for r in line_dedup.line_pieces(nodes, groups).collect()})
    assert found[0] == found[1] == found[2] == found[3] >= {(i, j) for i in range(9) for j in range(i + 1, i // 3 * 3 + 3)}
