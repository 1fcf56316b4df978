"""Native operators: quality rules and source mixing, by brute force and by DuckDB."""
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.llm import mixing, quality_rules
from flowlens.llm.queries import ORACLE, QUERIES
from flowlens.plans.oracle_check import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    found = compare(QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).execute(ORACLE[name]).df())
    assert found["columns_match"] and found["hash_match"], found


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(hit))


def test_rules_by_brute_force(spark, odd_docs):
    texts = ["a b c a b c", "a b c", "a a a a a", "x\n\ny\nx\n \nx", "#$ 😀😀 |é|\u00a0z", "one two\x0bthree\x0cfour\rfive"]
    docs = odd_docs.unionByName(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), allowMissingColumns=True)
    for r in quality_rules.judge(docs.withColumn("n_lines", F.lit("x"))).collect():
        n = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"the word{i} of it and that{i}" for i in range(40))
    bad = [" ".join(f"w{i}###" for i in range(90)), " | ".join(f"item{i}" for i in range(90)), "buy now today\n" * 40, "short text"]
    rows = quality_rules.judge(spark.createDataFrame([(0, prose), *enumerate(bad, 1)], "doc_id long, text string")).collect()
    assert [r.doc_id for r in rows if r.kept] == [0]


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100, 1), ("b", 1000, 1), ("c", 10, 1), (None, 500, 1), ("d", 0, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    order, size = ["a", "b", "c", "d", None], {"a": 100, "b": 1000, "c": 10, "d": 0, None: 500}
    weight = dict(zip(order, (3, 1, 2, 3, 1)))
    rest, left, want = set(order), 1.5 * 1610, {}
    while True:
        level = left / sum(weight[s] for s in rest)
        full = [s for s in rest if level * weight[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= want[s]
            rest.remove(s)
    want |= {s: level * weight[s] for s in rest}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1.5 * 1610)


def test_tree_keeps_quotas_and_halves(spark):
    quotas = {0: 1000, 1: 3000, 2: 0, 3: 7, 4: 1}
    rows = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "source_no int, blocks long"), 8, 3).collect()
    for s, q in quotas.items():
        assert sum(r.blocks for r in rows if r.source_no == s) == q and all(r.blocks >= 0 for r in rows)
    totals = [sum(r.blocks for r in rows if r.shard == k) for k in range(8)]
    assert max(totals) - min(totals) <= 3 and sum(totals) == sum(quotas.values())
    with pytest.raises(ValueError):
        mixing.split_tree(spark.createDataFrame([(0, 1)], "source_no int, blocks long"), 6, 3)


def test_hypergeometric_draws_follow_the_law(spark):
    import math
    n_all, kind, drawn, m = 30, 12, 10, 4000
    rows = spark.range(m).select(mixing.hypergeometric(F.lit(n_all).cast("long"), F.lit(kind).cast("long"), F.lit(drawn).cast("long"),
                                                       (F.col("id") + 0.5) / m).alias("k")).groupBy("k").count().collect()
    for r in rows:
        p = math.comb(kind, r.k) * math.comb(n_all - kind, drawn - r.k) / math.comb(n_all, drawn)
        assert r["count"] / m == pytest.approx(p, abs=2 / m)


def test_mix_of_a_table(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), "abc"[i % 7 % 3] if i % 11 else None, i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    placed, draws = mixing.plan(docs, n_shards=4, block_words=64)
    got = mixing.taken(placed, draws).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == r.doc_id % 17
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert len(by) == 4 and all(sum(t) == round(k[1]) for k, t in by.items())
    again = mixing.taken(*mixing.plan(docs.repartition(7), n_shards=4, block_words=64)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    blocks = {}
    for r in draws.collect():
        blocks.setdefault((r.source_no, r.block), set()).add(r.shard)
    assert all(len(s) == 1 for s in blocks.values())  # a block belongs to one shard
    mixed = mixing.mixed(docs, draws)
    assert mixed.columns == docs.columns and mixed.count() == draws.where("2 * take >= size").count()


def test_mix_of_odd_rows(spark, odd_docs):
    placed, draws = mixing.plan(odd_docs)
    assert mixing.taken(placed, draws).count() == odd_docs.count() and mixing.mixed(odd_docs, draws).columns == odd_docs.columns
    placed, draws = mixing.plan(odd_docs.limit(0))
    assert mixing.taken(placed, draws).count() == 0
