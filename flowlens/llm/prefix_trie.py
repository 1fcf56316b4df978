"""The prefix trie of conversations, built as a burst trie.

A turn's id is the MD5 of its role and text, followed by the length of the text; a conversation is the
array of its turn ids. Equal conversations are one suffix with a weight from the start.

1. Containers hold suffixes under a trie head, at first all of them under the root. A container with more than
   ``CAPACITY`` turns in several suffixes bursts: its head becomes a trie node (with the nodes of the turns that all of
   its suffixes begin with, found from the least and the greatest suffix), and its suffixes go to one container for each next turn
   id. This is repeated until no container is oversized; only oversized ones are read again.
2. The remaining containers are dealt by head, many to a task, and each is sorted and swept once, which yields its nodes.
3. Leaves and savings of the heads are summed from the last burst up to the root.

No group is held whole: the suffixes of a head that many conversations share are moved with a salt, and are split by
their next turns until they are small. Ids that end at a node are joined in segments of bounded size, each made
in its own task; the digest then reads segments, not ids. What a task does hold is one conversation's turn ids (24 bytes each).

Defined cases: a null role or text is empty; turns are ordered null first and, where equal, by turn id; rows with
a null conv_id belong to no conversation and are left out; repeated rows are turns of their own; ids keep
their sign in ``c % 5``, as in SQL; an empty table has no nodes; other columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 1_024   # turns in a container of several suffixes before it bursts
SALTS = 32         # parts in which the suffixes of a head are moved
SEGMENT = 50_000   # ids joined in one segment of a node's ends
ROOT = "root"


def turn_id(role: Column, text: Column) -> Column:
    """24 bytes: MD5 of role and text, and the length of the text in bytes."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    size = F.octet_length(text).cast("long")
    sign = F.md5(F.concat(F.lpad(F.hex(F.octet_length(role).cast("long")), 16, "0"), role, text))
    return F.unhex(F.concat(sign, F.lpad(F.hex(size), 16, "0")))


def text_bytes(turn: Column) -> Column:
    """The length of the text that a turn id carries (0 for none)."""
    return F.coalesce(F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("long"), F.lit(0).cast("long"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id and its turn ids in order."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), turn_id(F.col("role"), F.col("text")).alias("id")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["id"]).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % 5; h = crc32(c) % 9."""
    own = written(ordered_turns(turns), "trie-turns")
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    lead = own.select(F.col("conv_id").alias("base"), F.col("turns").alias("lead"))
    both = own.join(lead, c - c % 5 == F.col("base"), "left")
    first = F.slice(F.coalesce("lead", F.array().cast("array<binary>")), F.lit(1), h)
    return both.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def sequence_key(turns: Column) -> Column:
    return F.md5(F.array_join(F.transform(turns, F.hex), ""))


def _salted(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Joins rows with the row of their head; the rows of one head are moved in SALTS parts."""
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    spread = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(spread, ["head", "salt"]).drop("salt")


NODE_SCHEMA = ("conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
               "key string, top boolean, parent string")


def _size_of(turn: bytes) -> int:
    return int.from_bytes(turn[16:], "big")


def sweep(suffixes, depth: int, first_bytes: int, parent_low):
    """Nodes of one container: (low, depth, parent's low, n, children, leaves, saved, key) with its top node first.

    ``suffixes``: (key, turn ids, weight, smallest member) in lexicographic order, so that equal beginnings are
    neighbours and a node is done when a suffix leaves it."""
    low, at_depth, above, n, children, leaves, saved, keys = ([] for _ in range(8))
    size: list[int] = []

    def open_node(parent, text_size):
        low.append(None)
        at_depth.append(depth if parent < 0 else at_depth[parent] + 1)
        above.append(parent)
        size.append(text_size)
        n.append(0)
        children.append(0)
        leaves.append(0)
        saved.append(0)
        keys.append(None)
        return len(low) - 1

    def close(node):
        leaves[node] = leaves[node] or 1
        saved[node] += (n[node] - 1) * size[node]
        up = above[node]
        if up >= 0:
            n[up] += n[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            low[up] = low[node] if low[up] is None else min(low[up], low[node])

    stack, before = [open_node(-1, first_bytes)], ()
    for key, turns, weight, smallest in suffixes:
        same = 0
        while same < len(before) and same < len(turns) and before[same] == turns[same]:
            same += 1
        while len(stack) > same + 1:
            close(stack.pop())
        for turn in turns[same:]:
            stack.append(open_node(stack[-1], _size_of(turn)))
        node = stack[-1]
        n[node] += weight
        low[node] = smallest if low[node] is None else min(low[node], smallest)
        keys[node] = key
        before = turns
    while stack:
        close(stack.pop())
    return [(low[i], at_depth[i], parent_low if above[i] < 0 else low[above[i]], n[i], children[i], leaves[i], saved[i], keys[i]) for i in range(len(low))]


def _sweep_containers(batches):
    held, top = [], None

    def nodes():
        head, depth, first_bytes, parent, parent_low = top
        found = sweep(held, depth, first_bytes, parent_low)
        columns = [list(x) for x in zip(*found)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays += [pa.array([True] + [False] * (len(found) - 1)), pa.array([parent] + [None] * (len(found) - 1), pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in NODE_SCHEMA.split(", ")])

    for batch in batches:
        for r in batch.to_pylist():
            if top is not None and top[0] != r["head"]:
                yield nodes()
                held, top = [], None
            top = top or (r["head"], r["depth"], r["bytes"], r["parent"], r["parent_low"])
            held.append((r["key"], r["suffix"], r["n"], r["low"]))
    if top is not None:
        yield nodes()


def _segments(batches):
    """Sorted (key, conv_id) -> key, first id, ids joined by commas, at most SEGMENT in a row."""
    def segment(key, ids):
        return {"key": key, "first": int(ids[0]), "ids": ",".join(map(str, ids.tolist()))}

    schema = pa.schema([("key", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0).dictionary_encode(), np.asarray(batch.column(1))
        code = np.asarray(keys.indices)
        cuts = np.flatnonzero(np.diff(code, prepend=-1))
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
            out += [segment(keys.dictionary[int(code[a])].as_py(), ids[k:min(k + SEGMENT, b)]) for k in range(a, b, SEGMENT)]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _digests(batches):
    """Sorted segments -> key and SHA-256 of all its ids; only the running digest is kept."""
    key, running = None, None
    schema = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if k != key:
                if running:
                    out.append({"key": key, "ends_sha256": running.hexdigest()})
                key, running = k, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_py().encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if running:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": running.hexdigest()}], schema=schema)


def ends_digests(members: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest of the ids (ascending, joined by commas) of each sequence's conversations."""
    parts = (members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
             .mapInArrow(_segments, "key string, first long, ids string"))
    return written(parts, "trie-segments").repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends_sha256 string")


def prefix_trie(turns: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256."""
    members = written(rebuilt(turns).withColumn("key", sequence_key(F.col("turns"))), "trie-members")
    suffixes = members.groupBy("key").agg(F.first("turns").alias("suffix"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    none = F.lit(None)
    waiting = written(suffixes.select(F.lit(ROOT).alias("head"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bytes"), none.cast("string").alias("parent"),
                                      none.cast("long").alias("parent_low"), "key", "suffix", "n", "low"), "trie-waiting")
    settled, heads = [], []
    while True:
        sizes = waiting.groupBy("head").agg(F.count("*").alias("suffixes"), F.sum(F.size("suffix")).alias("turns"), F.sum("n").alias("n_convs"), F.min("low").alias("least"))
        large = written(sizes.where((F.col("turns") > capacity) & (F.col("suffixes") > 1)).select("head", "n_convs", "least"), "trie-large")
        if large.isEmpty():
            settled.append(waiting)
            break
        flagged = waiting.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(
            large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["head", "salt"], "left").drop("salt")
        flagged = written(flagged, "trie-flagged")
        settled.append(flagged.where("least is null").select(*waiting.columns))
        burst = flagged.where("least is not null")
        # what all suffixes of a head begin with is what the least and the greatest of them do
        ends = burst.groupBy("head", "n_convs", "least").agg(F.min("suffix").alias("a"), F.max("suffix").alias("z"))
        apart = F.array_position(F.transform(F.arrays_zip("a", "z"), lambda p: F.coalesce(p["a"] != p["z"], F.lit(True))), True)
        shared = written(ends.select("head", F.slice("a", F.lit(1), F.when(apart == 0, F.least(F.size("a"), F.size("z"))).otherwise(apart - 1).cast("int")).alias("chain")), "trie-shared")
        placed = written(_salted(burst, shared).withColumn("skip", F.size("chain")), "trie-placed")
        heads.append(written(placed.groupBy("head").agg(
            F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.first("parent").alias("parent"), F.first("parent_low").alias("parent_low"),
            F.first("n_convs").alias("n_convs"), F.first("least").alias("low"), F.first("chain").alias("chain"),
            F.max(F.when(F.size("suffix") == F.col("skip"), F.col("key"))).alias("key")), "trie-heads"))
        turn = F.get("suffix", F.col("skip"))
        waiting = written(placed.where(F.size("suffix") > F.col("skip")).select(
            F.md5(F.concat("head", F.hex(turn))).alias("child"), (F.col("depth") + F.col("skip") + 1).alias("depth"), text_bytes(turn).alias("bytes"),
            F.col("head").alias("parent"), F.col("least").alias("parent_low"), "key", F.slice("suffix", F.col("skip") + 2, F.size("suffix")).alias("suffix"), "n", "low")
            .withColumnRenamed("child", "head"), "trie-waiting")

    containers = settled[0]
    for part in settled[1:]:
        containers = containers.unionByName(part)
    swept = written(containers.select("head", "depth", "bytes", "parent", "parent_low", "key", "suffix", "n", "low").repartition("head")
                    .sortWithinPartitions("head", "suffix").mapInArrow(_sweep_containers, NODE_SCHEMA), "trie-swept")
    below = swept.where("top and parent is not null").select("parent", "n_leaves", "saved_tokens")
    parts = [swept.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "key")]
    for level in reversed(heads):
        sums = below.groupBy(F.col("parent").alias("head")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        turn_sizes = F.concat(F.array("bytes"), F.transform("chain", text_bytes))
        level = level.join(sums, "head").withColumn("sizes", turn_sizes).withColumn("skip", F.size("chain"))
        level = written(level, "trie-levels")
        nodes = level.select("*", F.explode(F.sequence(F.lit(0), F.col("skip"))).alias("i"))
        rest = F.aggregate(F.slice("sizes", F.col("i") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda s, x: s + x)
        nodes = nodes.select(F.col("low").alias("conv_id"), (F.col("depth") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
                             "n_convs", F.when(F.col("i") == F.col("skip"), F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
                             (F.col("saved") + (F.col("n_convs") - 1) * rest).alias("saved_tokens"), F.when(F.col("i") == F.col("skip"), F.col("key")).alias("key"), F.col("i"), "parent")
        parts.append(nodes.select(*parts[0].columns))
        tops = nodes.where((F.col("i") == 0) & F.col("parent").isNotNull()).select("parent", "n_leaves", "saved_tokens")
        below = swept.where("top and parent is not null").select("parent", "n_leaves", "saved_tokens").union(tops)
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)

    digests = ends_digests(members)
    nothing = hashlib.sha256(b"").hexdigest()
    own = [c for c in everything.columns if c != "key"]
    ending = everything.where("key is not null").join(digests, "key").select(*own, "ends_sha256")
    found = ending.unionByName(everything.where("key is null").select(*own, F.lit(nothing).alias("ends_sha256")))
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), *own[2:], "ends_sha256")
