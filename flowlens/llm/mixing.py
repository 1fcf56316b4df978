"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents, in the order of a seeded hash, form a stream of words that may be
read ``max_epochs`` times. A source's target is its quota of words, cut into blocks of
``block_words``. The tree splits the vector of block quotas over the output shards: at each
node the left half's blocks are a draw without replacement from all blocks of the node, so
the counts by source are multivariate hypergeometric and the quotas come out exactly. Within
a source a seeded permutation deals disjoint blocks to the shards, and a seeded hash
shuffles the documents of a shard.

A document belongs to the block in which its first word falls. Only the last document of a
quota is taken in part, so a source takes its rounded target to the word. All choices are
functions of ids and the seed: reruns agree.

Defined cases: a null source is a source of its own, after all others; null or blank texts have
size 0 and are never drawn; repeated rows and ids are separate documents (ties are ordered by
the row's content); an empty table gives an empty mix. The tables of sources, blocks and
shards are small (one row per source, or per ``block_words`` words); documents meet them in
joins that Spark may split.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_hash, written

ROWS_PER_RANGE = 4096  # rows of a source that one running sum covers


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights, share: float, max_epochs: int) -> DataFrame:
    """sizes (source, source_size) -> source_no by code point (null last), target.

    The share of all words goes to sources by weight; a source gets at most ``max_epochs`` times
    its size and the others share the excess by weight (the level at which the sum fits)."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    cap = F.col("source_size") * max_epochs
    numbered = (sizes.withColumn("source_no", F.row_number().over(in_order) - 1)
                .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1).cast("long")))
    by_ratio = Window.orderBy(cap / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    return (numbered
            .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("full", F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
            .withColumn("level", F.max(F.when(F.col("level") <= cap / F.col("weight"), F.col("level"))).over(everything))
            .select("source", "source_size", "n_docs", "source_no",
                    F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target")))


def uniform(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(n_all: Column, n_kind: Column, n_drawn: Column, u: Column) -> Column:
    """How many of ``n_kind`` among ``n_all`` are in a draw of ``n_drawn``, by inversion at ``u``.

    Weights follow the ratio of neighbouring probabilities over 12 standard deviations around
    the mean; beyond lies less than 1e-30."""
    d = lambda c: c.cast("double")
    low = F.greatest(F.lit(0).cast("long"), n_drawn - (n_all - n_kind))
    high = F.least(n_kind, n_drawn)
    mean = d(n_drawn) * d(n_kind) / F.greatest(d(n_all), F.lit(1.0))
    spread = F.lit(12.0) * F.sqrt(mean * (F.lit(1.0) - d(n_kind) / F.greatest(d(n_all), F.lit(1.0)))) + F.lit(20.0)
    a = F.greatest(low, F.floor(mean - spread))
    b = F.least(high, F.ceil(mean + spread))
    ks = F.sequence(a, F.greatest(a, b))

    def ratio(k):  # weight of k + 1 over that of k
        return d(n_kind - k) * d(n_drawn - k) / F.greatest(d(k + 1) * d(n_all - n_kind - n_drawn + k + 1), F.lit(1.0))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))
    total = F.aggregate(ks, start, lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum"), s["k"].alias("k")),
                        lambda s: s["sum"])
    pick = lambda goal: F.aggregate(ks, start, lambda s, k: F.struct(
        (s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum"),
        F.when((s["k"] < 0) & (s["sum"] + s["w"] > goal), k).otherwise(s["k"]).alias("k")),
        lambda s: F.when(s["k"] < 0, F.greatest(a, b)).otherwise(s["k"]))
    return F.element_at(F.transform(F.array(total * u), pick), 1)


def split_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """quotas (source_no, blocks) -> source_no, shard, blocks. ``n_shards`` is a power of two."""
    levels = n_shards.bit_length() - 1
    if 1 << levels != n_shards:
        raise ValueError("the number of shards must be a power of two")
    item = "array<struct<s:int,q:bigint>>"
    nodes = quotas.agg(F.lit(0).cast("long").alias("node"),
                       F.array_sort(F.collect_list(F.struct(F.col("source_no").alias("s"), F.col("blocks").alias("q")))).cast(item).alias("items"))
    for level in range(levels):
        every = F.aggregate("items", F.lit(0).cast("long"), lambda t, x: t + x["q"])
        # the odd block of a node goes left or right by chance
        half = F.floor(every / 2 + uniform(F.lit(seed), F.lit(level), F.col("node"))).cast("long")

        def deal(state, x):
            u = uniform(F.lit(seed), F.lit(level), F.col("node"), x["s"])  # noqa: B023
            k = hypergeometric(state["left"], x["q"], state["draw"], u).cast("long")
            return F.element_at(F.transform(F.array(k), lambda k: F.struct(
                (state["left"] - x["q"]).alias("left"), (state["draw"] - k).alias("draw"),
                F.concat(state["got"], F.array(k)).alias("got"))), 1)

        start = F.struct(F.col("every").alias("left"), F.col("half").alias("draw"), F.array().cast("array<bigint>").alias("got"))
        nodes = (nodes.withColumn("every", every).withColumn("half", F.least(F.col("every"), half))
                 .withColumn("got", F.aggregate("items", start, deal, lambda s: s["got"])))
        left = F.zip_with("items", "got", lambda x, k: F.struct(x["s"].alias("s"), k.alias("q"))).cast(item)
        right = F.zip_with("items", "got", lambda x, k: F.struct(x["s"].alias("s"), (x["q"] - k).alias("q"))).cast(item)
        nodes = nodes.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("items")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("items")))).alias("x")).select("x.node", "x.items")
    return nodes.select(F.col("node").cast("int").alias("shard"), F.explode("items").alias("x")).select(
        F.col("x.s").alias("source_no"), "shard", F.col("x.q").alias("blocks"))


def plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: int = 2, n_shards: int = 16,
         block_words: int = 1 << 14, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """Two tables: documents (row_key, doc_id, size, source_size, target and their place in the
    stream) and draws (row_key, copy, shard, block, take, place): what each shard takes."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                word_count(F.col(text_col)).alias("size"), order.alias("order"),
                                row_hash(*map(F.col, docs.columns)).alias("row_key")), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")),
                      weights, share, max_epochs)
    sources = written(sources.withColumn("quota", F.round("target").cast("long")), "mix-sources")

    # running sums: within ranges of the hash order, plus the ranges before
    ranged = (sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
              .withColumn("ranges", F.ceil(F.col("n_docs") / ROWS_PER_RANGE))
              .withColumn("range", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(float(1 << 32)))))
    before = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("source_no", "range").agg(F.sum("size").alias("words"))
               .withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words"))
    here = Window.partitionBy("source_no", "range").orderBy("order", "doc_id", "row_key", "size")
    placed = (ranged.withColumn("row_no", F.row_number().over(here))
              .withColumn("start", F.coalesce(F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .join(offsets, ["source_no", "range"])
              .withColumn("start", F.col("start") + F.col("offset"))
              .select("doc_id", "row_key", "source_no", "range", "row_no", "size", "source_size", "target", "quota", "start"))
    placed = written(placed, "mix-documents")

    blocks = sources.where("quota > 0").select(
        "source_no", F.ceil(F.col("quota") / block_words).cast("long").alias("blocks"))
    first = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = (split_tree(blocks, n_shards, seed).where("blocks > 0")
             .withColumn("from", F.coalesce(F.sum("blocks").over(first), F.lit(0)))
             .select("source_no", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("blocks") - 1)).alias("slot")))
    permuted = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed), F.col("source_no"), F.col("block")), "block")
    dealt = (blocks.select("source_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
             .withColumn("slot", F.row_number().over(permuted).cast("long") - 1)
             .join(slots, ["source_no", "slot"]).select("source_no", "block", "shard"))

    at = F.col("start") + F.col("copy") * F.col("source_size")
    draws = (placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_epochs - 1).cast("long"))))
             .withColumn("take", F.least(F.col("size"), F.col("quota") - at)).where("take > 0")
             .withColumn("block", F.floor(at / block_words).cast("long"))
             .join(dealt, ["source_no", "block"])
             .withColumn("place", F.xxhash64(F.lit(seed), "shard", "row_key", "row_no", "copy"))
             .select("source_no", "range", "row_no", "row_key", "copy", "shard", "block", "size", "take", "place"))
    return placed, draws


def taken(placed: DataFrame, draws: DataFrame) -> DataFrame:
    """Words taken from every document, 0 included."""
    row = ["source_no", "range", "row_no"]
    sums = draws.groupBy(*row).agg(F.sum("take").alias("taken"))
    return (placed.join(sums, row, "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed(docs: DataFrame, draws: DataFrame) -> DataFrame:
    """The documents of the mix, whole, once for each copy, ordered by shard and shuffled within.

    The last document of a quota stays if at least half of it is taken. Rows that are equal in
    all columns share their draws."""
    key = "_mix_row_key"
    own = docs.withColumn(key, row_hash(*map(F.col, docs.columns))).dropDuplicates([key])
    whole = (draws.where("2 * take >= size").groupBy(F.col("row_key").alias(key))
             .agg(F.collect_list(F.struct("shard", "place")).alias("_mix_draws")))
    rows = own.join(whole, key).withColumn("_mix_draw", F.explode("_mix_draws"))
    return rows.repartitionByRange("_mix_draw").sortWithinPartitions("_mix_draw").select(*docs.columns)
