"""Exact Jaccard self-join of word-shingle sets: a size-aware heavy-light join.

Tokens are 64-bit hashes of the shingles in one global order: rare ones by hash, then the
heavy ones (a table of at most ``HEAVY`` tokens that many documents share; it only orders, any
table gives the same links). Two sets that link must share c tokens among the first
n - ceil(t n) + c of each (prefix filter).

* Small sets enumerate all c = 2 subsets of that prefix; sets meet where a subset is equal.
* Large sets, and the small ones near enough in size to link with them, enter inverted lists
  of single tokens (c = 1), which are scanned.
* The boundary is the one of least cost: subsets enumerated against list entries times
  ``SCAN_COST``, summed over the sizes of all sets.

Neither may emit all pairs of a group of copies. First each list, in order of node, pairs
neighbours, and every set with the list's hub; pairs that share many lists are verified exactly
and give components. Sets that share many lists with a large component without a link to it are
then compared with some of its members. At last, pairs of different components follow: those that share a
subset, and of the inverted lists those that share as many prefix tokens as a link must (token_pairs: a set
meets the sizes of its lists first, and then only as many of its shortest lists as it takes to miss no partner). A link
whose ends were already connected cannot change a component, and every other pair that could link is verified, so components are
exact. Equal sets are one node from the start.

Lists are dealt by range of (token, node): a token of very many sets spreads over tasks.

Defined cases: null, empty and blank texts have no set, link with nothing and are their own
component; fewer words than a shingle form one shingle; repeated rows and ids share a
node; a component whose ids are all null has a null id; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import maybe_in, written
from .components import connected_components, cross_pairs

HEAVY = 1 << 18        # tokens in the heavy table, which travels with the tasks (2 MB)
LOCAL_HEAVY = 3        # documents of one batch that share a token before the batch reports it
SCAN_COST = 3          # a list entry scanned, in subsets enumerated
BOUNDARIES = (0, 4, 8, 12, 16, 20, 24, 28, 32, 40, 48, 64)
SUBSET = 2
TURNS, MEMBERS = 1, 4  # rounds, and members of a large component that a set outside is compared with in each


def needed(n, percent: int):
    """Least overlap of a set of n with any set that links with it (ceil)."""
    return -((-n * percent) // 100)


def doc_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Distinct shingle hashes of each document, sorted, one after another, and their numbers."""
    lower = K.ascii_lower(data)
    starts, ends, counts = K.word_spans(lower, offsets)
    h, per_doc = K.shingle_hashes(K.span_hashes(lower, starts, ends), counts, width)
    cuts = np.append(0, np.cumsum(per_doc))
    sets = [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return sets


def fingerprints(sets) -> np.ndarray:
    """64-bit node ids of sets from two sums of mixed tokens."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(sets), np.uint64)
        for i, s in enumerate(sets):
            if len(s):
                m = K.mix64(s)
                out[i] = K.mix64(np.array([m.sum()], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                                 + K.mix64(m ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum() + np.uint64(len(s)))[0]
        return out.view(np.int64)


def _each_slice(batch, width):
    """(ids, node ids, sets) of bounded slices of a batch."""
    data, offsets = K.text_buffers(batch.column(1))
    for a, b in K.slices(offsets):
        sets = doc_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)
        yield batch.column(0).slice(a, b - a), fingerprints(sets), sets


def _members(width):
    """kind 0: doc_id, node, n of every document; kind 1: token, documents of a batch that share it."""
    def run(batches):
        for batch in batches:
            seen, tokens = set(), []
            for ids, nodes, sets in _each_slice(batch, width):
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), ids, pa.array(nodes), pa.array(sizes)],
                                                 names=["kind", "doc_id", "node", "n"])
                for node, s in zip(nodes.tolist(), sets):
                    if node not in seen:  # copies count once
                        seen.add(node)
                        tokens.append(s)
            # a batch has a bounded number of bytes, so have its tokens
            token, many = np.unique(np.concatenate(tokens or [np.zeros(0, np.uint64)]), return_counts=True)
            often = many >= LOCAL_HEAVY
            k = int(often.sum())
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.nulls(k, pa.int64()), pa.array(token[often].view(np.int64)),
                                                  pa.array(many[often].astype(np.int64))], names=["kind", "doc_id", "node", "n"])
    return run


def in_order(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The global order of tokens: light ones, then heavy ones, each by hash."""
    if not len(heavy):
        return s
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    is_heavy = heavy[at] == s
    return np.concatenate([s[~is_heavy], s[is_heavy]])


def set_keys(s: np.ndarray, percent: int, boundary: int):
    """Keys of one set in global order, and for each the place of its last token and its tokens."""
    n = len(s)
    keep = n - needed(n, percent)
    keys, places, sizes = [], [], []
    if n <= boundary and n > 1:
        p = s[:keep + SUBSET]
        i, j = np.triu_indices(len(p), 1)
        with np.errstate(over="ignore"):
            keys.append(K.mix64(K.mix64(p[i] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xFF51AFD7ED558CCD) + p[j]))
        places.append(j)
        sizes.append(np.full(len(j), SUBSET))
    if n > boundary or n >= needed(boundary + 1, percent):
        p = s[:keep + 1]
        keys.append(p)
        places.append(np.arange(len(p)))
        sizes.append(np.ones(len(p), np.int64))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(places), np.concatenate(sizes)


def _postings(width, percent, boundary, heavy):
    def run(batches):
        for _, nodes, sets in (x for batch in batches for x in _each_slice(batch, width)):
            keys, node, n, place, c = [], [], [], [], []
            seen = set()
            for v, s in zip(nodes.tolist(), sets):
                if not len(s) or v in seen:
                    continue
                seen.add(v)
                k, p, q = set_keys(in_order(s, heavy), percent, boundary)
                keys.append(k)
                place.append(p)
                c.append(q)
                node.append(np.full(len(k), v, np.int64))
                n.append(np.full(len(k), len(s), np.int64))
            if keys:
                pack = (np.concatenate(n) << 32) | (np.concatenate(place) << 2) | np.concatenate(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(node)), pa.array(pack)],
                                                 names=["key", "node", "pack"])
    return run


def may_link(pack_a, pack_b, percent: int):
    """Whether two entries of a list can be the first c common tokens of two sets that link."""
    na, nb, c = pack_a >> 32, pack_b >> 32, pack_a & 3
    pa_, pb = (pack_a & 0xFFFFFFFF) >> 2, (pack_b & 0xFFFFFFFF) >> 2
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    most = c + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (100 * low >= percent * high) & (c == (pack_b & 3)) & ((100 + percent) * most >= percent * (na + nb))


def _neighbours(percent):
    """Sorted entries -> those in lists of several entries, each with the node before it if they may link."""
    def batch_of(x):
        return pa.RecordBatch.from_arrays([pa.array(x["key"]), pa.array(x["node"]), pa.array(x["pack"]),
                                           pa.array(x["before"], mask=~x["has"])], names=["key", "node", "pack", "before"])

    def run(batches):
        carry = None  # the last entry, whose successor is still unknown
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: np.asarray(batch.column(i)) for i, c in enumerate(("key", "node", "pack"))}
            if carry:
                x = {c: np.append(carry[c], v) for c, v in x.items()}
            same = x["key"][1:] == x["key"][:-1]
            x["shared"] = np.append(False, same) | np.append(same, False)
            x["before"] = np.append(0, x["node"][:-1])
            x["has"] = np.append(False, same & (x["node"][1:] != x["node"][:-1]) & may_link(x["pack"][:-1], x["pack"][1:], percent))
            if carry:
                x["shared"][0] |= carry["shared"][0]
                x["before"][0], x["has"][0] = carry["before"][0], carry["has"][0]
            else:
                x["shared"][0] = True  # its list may begin in another task
            carry = {c: v[-1:] for c, v in x.items()}
            out = np.flatnonzero(x["shared"][:-1])
            if len(out):
                yield batch_of({c: v[out] for c, v in x.items()})
        if carry:
            yield batch_of(carry)  # its list may go on in another task
    return run


def _sets(width):
    def run(batches):
        for _, nodes, sets in (x for batch in batches for x in _each_slice(batch, width)):
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])
    return run


def _row_nodes(width):
    """row, id, text -> row, id and the node of its set (0: none)."""
    def run(batches):
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for a, b in K.slices(offsets):
                nodes = fingerprints(doc_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(nodes)], names=["row", "id", "node"])
    return run


def _verify(percent):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                ok[i] = (100 + percent) * common >= percent * (len(x) + len(y))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])
    return run


def least_shared(low, high, percent: int):
    """How many tokens two linked sets of these sizes share within their prefixes, at least.

    Of the prefix that ends first, at most its size less the needed overlap is missing from the
    other set, and what both have lies in both prefixes."""
    overlap = F.ceil((low + high) * percent / (100 + percent))
    return overlap - F.ceil(high * percent / 100) + 1


def choose_boundary(nodes: DataFrame, percent: int) -> int:
    """The size up to which subsets are enumerated, of least cost over all sets."""
    n = F.col("n")
    keep = n - F.ceil(n * percent / 100)
    subsets = (keep + SUBSET) * (keep + SUBSET - 1) / 2
    scan = (keep + 1) * SCAN_COST
    costs = []
    for b in BOUNDARIES:
        near = n >= needed(b + 1, percent)
        costs.append(F.sum(F.when(n <= b, subsets + F.when(near, scan).otherwise(0)).otherwise(scan)).alias(str(b)))
    row = nodes.agg(*costs).first()
    return min(BOUNDARIES, key=lambda b: (row[str(b)] or 0, b))


def token_pairs(entries: DataFrame, components: DataFrame, done: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share as many prefix tokens as a link of their sizes
    must (least_shared), are not in ``done`` and hold a set above the boundary: no other pair of inverted lists can link.

    A set meets the sizes of a list before it meets the sets: only if at least s of its k lists hold a set of size m of
    another component can it link with one of that size. Such a partner stands in one of any k - s + 1 of these lists, so
    only the shortest ones are joined, and only towards the larger component. Rows of the size tables grow
    with the entries, as a list has less than n sizes that can link with n."""
    sized = (entries.select("key", "node", F.shiftright("pack", 32).alias("n")).distinct().join(components, "node", "left")
             .select("key", "node", "n", F.coalesce("component", "node").alias("component")))
    members = components.groupBy("component").agg(F.count("*").alias("members"))
    placed = written(sized.join(members, "component", "left")
                     .select("key", "node", "n", F.struct(F.coalesce("members", F.lit(1)).alias("members"), "component").alias("rank")), "jaccard-sized")
    low, high = F.least("n", "m"), F.greatest("n", "m")
    must = least_shared(low, high, percent)

    def met(rows: DataFrame, condition) -> DataFrame:
        """Each entry with the sizes m in its list that can link with it."""
        cells = rows.groupBy("key", F.col("n").alias("m")).agg(F.min("rank").alias("least"), F.max("rank").alias("most"), F.count("*").alias("c"))
        return rows.join(cells, "key").where((100 * low >= percent * high) & (high > boundary) & condition)

    for _ in range(2):  # sets that cannot link leave the lists; the second pass finds those that met only such sets
        fits = (met(placed, (F.col("least") != F.col("rank")) | (F.col("most") != F.col("rank")))
                .groupBy("node", "n", "m").agg(F.count("*").alias("k")).where(F.col("k") >= must))
        sizes = fits.groupBy("node").agg(F.collect_set("m").alias("sizes"))
        placed = written(placed.select("key", "node", "n", "rank").join(sizes, "node"), "jaccard-sized")
    up = met(placed, (F.col("most") > F.col("rank")) & F.array_contains("sizes", F.col("m")))
    of_size = Window.partitionBy("node", "m")
    chosen = (up.withColumn("k", F.count("*").over(of_size))
              .withColumn("place", F.row_number().over(of_size.orderBy("c", "key")))
              .where((F.col("k") >= must) & (F.col("place") <= F.col("k") - must + 1))
              .select("key", "node", "n", "m", "rank"))
    x, y = written(chosen, "jaccard-chosen").alias("x"), placed.alias("y")
    found = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.m") == F.col("y.n")) & (F.col("x.rank") < F.col("y.rank"))
                    & F.array_contains("y.sizes", F.col("x.n")))
             .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    found = written(found.join(done, ["a", "b"], "left_anti"), "jaccard-met")
    tokens = written(placed.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("key").alias("keys")), "jaccard-prefixes")
    of = lambda end, n, keys: tokens.select(F.col("node").alias(end), F.col("n").alias(n), F.col("keys").alias(keys))
    return (found.join(of("a", "n", "keys"), "a").join(of("b", "m", "others"), "b")
            .where(F.size(F.array_intersect("keys", "others")) >= must).select("a", "b"))


def classes_of_sets(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str):
    """Two tables: doc_id, node and n of every row (n = 0: no set); node, component and component_id of every set."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(rows.mapInArrow(_members(width), "kind byte, doc_id long, node long, n long"), "jaccard-members")
    members = found.where("kind = 0").drop("kind")
    heavy_rows = (found.where("kind = 1").groupBy("node").agg(F.sum("n").alias("c"))
                  .orderBy(F.desc("c"), "node").limit(HEAVY).select("node").collect())  # bounded by HEAVY
    heavy = np.sort(np.array([r[0] for r in heavy_rows], np.int64).view(np.uint64))
    nodes = written(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "jaccard-nodes")
    boundary = choose_boundary(nodes, percent)

    entries = rows.mapInArrow(_postings(width, percent, boundary, heavy), "key long, node long, pack long")
    lists = written(entries.repartitionByRange("key", "node").sortWithinPartitions("key", "node", "pack")
                    .mapInArrow(_neighbours(percent), "key long, node long, pack long, before long"), "jaccard-lists")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by exact comparison of their whole sets."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ids = nodes.join(wanted, "node").select("doc_id")
        sets = (maybe_in(rows, F.col("doc_id"), ids).mapInArrow(_sets(width), "node long, tokens binary")
                .join(wanted, "node", "left_semi").dropDuplicates(["node"]))
        sets = written(sets, "jaccard-sets")
        of = lambda end: sets.select(F.col("node").alias(end), F.col("tokens").alias(f"tokens_{end}"))
        return (pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "tokens_a", "tokens_b")
                .mapInArrow(_verify(percent), "a long, b long"))

    size = F.shiftright("pack", 32)
    kind = F.col("pack").bitwiseAND(F.lit(3))

    def promising(found: DataFrame) -> DataFrame:
        """Pairs (a, b) of a table of shared lists that may well link; what this leaves out meets below."""
        sums = found.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("c").alias("c"), F.max("n").alias("n"))
        return sums.where((F.col("c") == SUBSET) | (F.col("shared") * 2 >= least_shared(F.col("n"), F.col("n"), percent))).select("a", "b")

    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    chain = lists.where("before is not null").select(*ends("before", "node"), kind.alias("c"), size.alias("n"))
    # the hub of a list: the set of which the largest share of keys is found elsewhere too (an unedited original)
    full = F.max(size) - F.ceil(F.max(size) * percent / 100) + 1
    weights = lists.groupBy("node").agg((F.count("*") / full).alias("weight"))
    entries = written(lists.select("key", "node", "pack").distinct().join(weights, "node"), "jaccard-entries")
    hubs = entries.groupBy("key").agg(F.max_by(F.struct("node", "pack"), F.struct("weight", "node")).alias("hub"))
    star = (entries.join(hubs, "key").where((F.col("node") != F.col("hub.node")) & (kind == F.col("hub.pack").bitwiseAND(F.lit(3))))
            .select(*ends("node", "hub.node"), kind.alias("c"), F.greatest(size, F.shiftright("hub.pack", 32)).alias("n")))
    done = written(promising(chain).union(promising(star)).distinct(), "jaccard-pairs")
    links = written(verified(done), "jaccard-links")
    first = connected_components(links)

    # sets that share many lists with a large component but have no link to it yet: some of its members
    for turn in range(TURNS):
        large = first.groupBy("component").agg(F.count("*").alias("members"), *(
            F.min_by("node", F.xxhash64(F.lit(turn), F.lit(k), F.col("node"))).alias(f"m{k}") for k in range(MEMBERS))).where(F.col("members") >= 2 * MEMBERS)
        placed = written(entries.select("key", "node", "pack").join(first, "node", "left")
                         .withColumn("component", F.coalesce("component", "node")), "jaccard-placed")
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
        main = (parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts"))
                .where("parts > 1").join(large.select(F.col("component").alias("main")), "main", "left_semi").select("key", "main"))
        outside = (placed.join(main, "key").where(F.col("component") != F.col("main"))
                   .select(F.col("node").alias("a"), F.col("main").alias("b"), kind.alias("c"), size.alias("n")))
        tries = promising(outside).withColumnRenamed("a", "node").withColumnRenamed("b", "component")
        tries = tries.join(large, "component").select("node", F.explode(F.array_distinct(F.array(*(f"m{k}" for k in range(MEMBERS))))).alias("member"))
        tries = written(tries.select(*ends("node", "member")).distinct().join(done, ["a", "b"], "left_anti"), "jaccard-pairs")
        if not tries.head(1):
            break
        links = written(links.union(verified(tries)), "jaccard-links")
        done = done.union(tries)
        first = connected_components(links)

    # lists with several components: everything that could still join two of them
    n = lambda t: F.shiftright(f"{t}.pack", 32)
    rest = lambda t: n(t) - F.shiftright(F.col(f"{t}.pack").bitwiseAND(F.lit(0xFFFFFFFF)), 2) - 1
    low, high = F.least(n("x"), n("y")), F.greatest(n("x"), n("y"))
    can = (100 + percent) * (SUBSET + F.least(rest("x"), rest("y"))) >= percent * (low + high)
    plain = entries.select("key", "node", "pack")
    subsets = cross_pairs(plain.where(kind == SUBSET), first, done, lambda x, y: (100 * low >= percent * high) & can)
    cross = subsets.union(token_pairs(plain.where(kind == 1), first, done, percent, boundary)).distinct()
    more = written(verified(cross), "jaccard-links")
    final = connected_components(links.union(more))

    of_node = nodes.join(final, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    of_node = written(of_node, "jaccard-components")
    least = written(of_node.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    return members, written(of_node.join(least, "component").select("node", "component", "component_id"), "jaccard-ids")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``."""
    members, ids = classes_of_sets(docs, width, percent, id_col, text_col)
    linked = members.where("n > 0").join(ids, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(members.where("n = 0").select("doc_id", "n", F.col("doc_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id (null last), among equal ids of the smallest set; rows without a set stay.

    Rows are told apart by id and set, so an id that stands with several texts loses only those that have a near copy elsewhere.
    Of rows equal in id and text one stays, with or without a set."""
    members, ids = classes_of_sets(docs, width, percent, id_col, text_col)
    sets = members.where("n > 0").join(ids, "node").select("doc_id", "node", "component").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    first = sets.groupBy("component").agg(F.min(order).alias("first"))
    lost = (sets.join(first, "component").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))))
            .select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_jaccard_id"), F.col("node").alias("_jaccard_node")))
    lost = written(lost.distinct(), "jaccard-lost")
    own = docs.withColumn("_jaccard_row", F.xxhash64(id_col, text_col, F.col(id_col).isNull(), F.col(text_col).isNull()))
    keyed = own.select(F.col("_jaccard_row").alias("row"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    gone = (keyed.mapInArrow(_row_nodes(width), "row long, id string, node long")
            .join(lost, (F.col("id") == F.col("_jaccard_id")) & (F.col("node") == F.col("_jaccard_node")), "left_semi").select(F.col("row").alias("_jaccard_row")).distinct())
    kept = own.join(gone, "_jaccard_row", "left_anti")
    # rows without a set have no component; of rows with one set under one id, which may differ in white space or case, one stays
    same = kept.select("_jaccard_row", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    nodes = same.mapInArrow(_row_nodes(width), "row long, id string, node long")
    one = nodes.groupBy("id", "node", F.when(F.col("node") == 0, F.col("row")).alias("blank")).agg(F.min("row").alias("_jaccard_row")).select("_jaccard_row")
    return kept.join(one, "_jaccard_row", "left_semi").dropDuplicates(["_jaccard_row"]).select(*docs.columns)
