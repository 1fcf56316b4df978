"""Near-duplicate vectors by a PCA-ordered tiled comparison (exact for a cosine threshold).

Unit vectors are turned into the axes of a principal component analysis, strongest first,
and dealt into tiles by range of the first coordinate; tiles next to each other form blocks. Vectors that link lie within
sqrt(2 - 2 t) of each other, so only blocks and tiles whose first coordinates come that near are compared.
A task gets the tiles of two blocks once, holds one block and compares each tile of the other with it. Blocks at one
distance in the order are compared at a time, so a round deals every tile twice at most, however many pairs of blocks there are.
A comparison of two tiles takes products over the leading axes for all pairs at once,
adds the product of the suffix norms (Cauchy-Schwarz) as the most that the rest can give, and
goes on with the pairs that can still reach the threshold; the last step takes the given
components in double precision.

The axes come from at most ``SAMPLE`` vectors: they only order the work, results do not depend
on them. Equal vectors are one node with a count. A pair of blocks returns link counts by node and
a spanning forest, never all pairs of a group.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing (component: their own id); vectors of different length do not link; repeated rows
count as links of each other; a row with a null id is counted, has the component of its
links and is never kept; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, FloatType, ShortType

from .common import written
from .components import connected_components

SAMPLE = 20_000
TILE = 2048
SLACK = 1e-4      # of single-precision bounds
BLOCK_MB = 16     # vectors of a block; a task holds one block, turned too
BLOCKS_A_CORE = 1.5
ROUND_MB = 256    # tiles that a round may deal even if the table is smaller
ROWS = 256        # rows of a tile that meet the other tile at a time
PAIRS = 50_000    # pairs whose components are held at a time


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Columns: eigenvectors of the second moments, strongest first."""
    _, axes = np.linalg.eigh(vectors.T @ vectors)
    return np.ascontiguousarray(axes[:, ::-1])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _turn(axes):
    """node, copies, v -> with the first turned coordinate; rows of one length by turns."""
    def run(batches):
        for batch in batches:
            v = batch.column(2)
            lens = np.asarray(v.value_lengths())
            for dim in np.unique(lens):
                part = batch.filter(pa.array(lens == dim))
                y = _unit(_matrix(part.column(2), dim))
                first = y @ axes[dim][:, 0] if dim in axes else y[:, 0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(y), dim, np.int32)), pa.array(first)],
                                                 names=["node", "copies", "v", "dim", "first"])
    return run


TILE_SCHEMA = "tile long, dim int, size int, low double, high double, nodes binary, copies binary, v binary"


def _pack(kind: str):
    """Sorted vectors -> tiles; components are kept as ``kind``."""
    tile = TILE

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            dims = np.asarray(batch.column(3))
            cuts = np.append(0, np.flatnonzero(np.diff(dims)) + 1)
            for a, b in zip(cuts, np.append(cuts[1:], len(dims))):
                for s in range(a, b, tile):
                    part = batch.slice(s, min(tile, b - s))
                    first = np.asarray(part.column(4))
                    yield pa.RecordBatch.from_pydict({
                        "tile": pa.array([number], pa.int64()), "dim": pa.array([dims[s]], pa.int32()), "size": pa.array([part.num_rows], pa.int32()),
                        "low": [first.min()], "high": [first.max()],
                        "nodes": [np.asarray(part.column(0)).tobytes()], "copies": [np.asarray(part.column(1)).tobytes()],
                        "v": [_matrix(part.column(2), int(dims[s])).astype(kind).tobytes()]})
                    number += 1
    return run


def steps(dim: int):
    """Borders of the blocks of axes: 16 at first, then doubling."""
    at, out = min(16, dim), []
    while at < dim:
        out.append(at)
        at *= 2
    return [*out, dim]


class Tile:
    """Unit vectors u, the same in single precision along the axes (y), and what the axes after each step can still give."""

    def __init__(self, x: np.ndarray, axes: np.ndarray | None):
        self.u = _unit(x)
        self.y = (self.u if axes is None else self.u @ axes).astype(np.float32)
        self.blocks = steps(x.shape[1])
        self.tails = [np.sqrt((self.y[:, k:].astype(np.float64) ** 2).sum(axis=1)).astype(np.float32) for k in self.blocks]
        # the product of two such rows is the product over the leading axes and the most of the rest
        self.most = np.column_stack([self.y[:, :self.blocks[0]], self.tails[0]])


def linked_pairs(a: Tile, b: Tile | None, threshold: float):
    """Index pairs of rows whose cosine reaches the threshold, some at a time; b None: pairs within a."""
    other, goal = a if b is None else b, threshold - SLACK
    for start in range(0, len(a.u), ROWS):
        first = start + 1 if b is None else 0
        i, j = np.nonzero(a.most[start:start + ROWS] @ other.most[first:].T >= goal)
        i, j = i + start, j + first
        if b is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), PAIRS):
            p, q = i[s:s + PAIRS], j[s:s + PAIRS]
            k = a.blocks[0]
            d = np.einsum("ij,ij->i", a.y[p, :k], other.y[q, :k])
            for at, (k, m) in enumerate(zip(a.blocks, a.blocks[1:]), 1):
                d = d + np.einsum("ij,ij->i", a.y[p, k:m], other.y[q, k:m])
                ok = d + a.tails[at][p] * other.tails[at][q] >= goal
                p, q, d = p[ok], q[ok], d[ok]
            exact = np.einsum("ij,ij->i", a.u[p], other.u[q]) >= threshold
            if exact.any():
                yield p[exact], q[exact]


def forest(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The smallest reachable index for each, from roots and further links."""
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class BlockPair:
    """Links among the tiles of two blocks, or of one, as they come."""

    def __init__(self, threshold: float, width: float):
        self.threshold, self.width = threshold, width
        self.held, self.starts, self.nodes, self.copies = [], [], [], []
        self.links, self.root, self.waiting, self.n_waiting = np.zeros(0), np.zeros(0, np.int64), [], 0

    def add(self, tile: Tile, low: float, high: float, nodes: np.ndarray, copies: np.ndarray, hold: bool, meet: bool) -> None:
        at = len(self.links)
        self.nodes.append(nodes)
        self.copies.append(copies)
        self.links = np.append(self.links, np.zeros(len(nodes)))
        self.root = np.append(self.root, np.arange(at, at + len(nodes)))
        for other, start, low_o, high_o, copies_o in self.held if meet else ():
            if low - high_o <= self.width and low_o - high <= self.width:
                for i, j in linked_pairs(other, tile, self.threshold):
                    self._link(i + start, j + at, copies_o[i], copies[j])
        if hold and meet:
            for i, j in linked_pairs(tile, None, self.threshold):
                self._link(i + at, j + at, copies[i], copies[j])
        if hold:
            self.held.append((tile, at, low, high, copies))

    def _link(self, i, j, copies_i, copies_j) -> None:
        n = len(self.links)
        self.links += np.bincount(i, copies_j, n) + np.bincount(j, copies_i, n)
        new = self.root[i] != self.root[j]
        self.waiting.append((i[new], j[new]))
        self.n_waiting += int(new.sum())
        if self.n_waiting > 4 * PAIRS:
            self._join()

    def _join(self) -> None:
        if self.n_waiting:
            self.root = forest(*(np.concatenate(x) for x in zip(*self.waiting)), self.root)
        self.waiting, self.n_waiting = [], 0

    def found(self):
        """kind 0: node, copies linked; kind 1: edge to a root."""
        self._join()
        hit, edge = np.flatnonzero(self.links), np.flatnonzero(self.root != np.arange(len(self.root)))
        if len(hit):
            nodes = np.concatenate(self.nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(np.zeros(len(hit), np.int8), np.ones(len(edge), np.int8))),
                 pa.array(np.append(nodes[hit], nodes[edge])),
                 pa.array(np.append(self.links[hit].astype(np.int64), nodes[self.root[edge]]))], names=["kind", "a", "b"])


def _compare(axes, threshold: float, width: float, kind: str):
    """Tiles by pair of blocks, those of the first block (side 0) first -> links."""
    def run(batches):
        pair, found = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                value = lambda name: row[name].as_py()  # noqa: B023,E731
                raw = lambda name, t: np.frombuffer(row[name].as_buffer(), t)  # noqa: B023,E731
                if pair != (value("i"), value("j")):
                    if found:
                        yield from found.found()
                    pair, found = (value("i"), value("j")), BlockPair(threshold, width)
                dim, side = value("dim"), value("side")
                x = raw("v", kind).astype(np.float64).reshape(-1, dim)
                found.add(Tile(x, axes.get(dim)), value("low"), value("high"), raw("nodes", np.int64), raw("copies", np.int64),
                          side == 0, side == 1 or pair[0] == pair[1])
        if found:
            yield from found.found()
    return run


def _links(tiles: DataFrame, size: int, axes: dict, threshold: float, kind: str) -> DataFrame:
    """kind, a, b of all pairs of blocks that may link."""
    spark = tiles.sparkSession
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    about = tiles.select("tile", "dim", "size", "low", "high")
    mb = about.agg(F.sum(F.col("size").cast("double") * F.col("dim"))).first()[0] or 0.0
    mb *= np.dtype(kind).itemsize / 1e6
    n_blocks = max(mb / BLOCK_MB, BLOCKS_A_CORE * spark.sparkContext.defaultParallelism, 1)
    rows = max(TILE, int(size / n_blocks) + 1)
    # a row a tile, so one window is enough
    before = F.coalesce(F.sum("size").over(Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = about.withColumn("part", F.floor(before / rows))
    block = F.dense_rank().over(Window.orderBy("dim", "part")).cast("long")
    of_tile = written(starts.select("tile", "dim", "low", "high", block.alias("block")), "vector-blocks")
    blocks = of_tile.groupBy("block", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    cells = blocks.select("block", "dim", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("cell"))
    near = cells.select(F.col("block").alias("j"), "dim", F.col("low").alias("low_j"), F.col("high").alias("high_j"),
                        F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    pairs = written(cells.withColumnRenamed("block", "i").join(near, ["dim", "cell"])
                    .where((F.col("i") <= F.col("j")) & (F.col("low_j") - F.col("high") <= width) & (F.col("low") - F.col("high_j") <= width))
                    .select("i", "j").distinct(), "vector-block-pairs")

    farthest = pairs.agg(F.max(F.col("j") - F.col("i"))).first()[0]
    at_once = max(1, int(max(ROUND_MB, mb) / max(2 * mb, 1e-9)))   # distances whose tiles a round deals
    found = None
    for at in range(0, (-1 if farthest is None else farthest) + 1, at_once):
        here = pairs.where((F.col("j") - F.col("i")).between(at, at + at_once - 1))
        sides = here.select("i", "j", F.explode(F.expr("if(i = j, array(struct(0 as side, i as block)), array(struct(0 as side, i as block), struct(1 as side, j as block)))")).alias("s"))
        sent = of_tile.select("tile", "block").join(sides.select("i", "j", "s.side", "s.block"), "block").drop("block")
        sent = tiles.join(F.broadcast(sent), "tile")  # two rows a tile and distance
        n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), here.count())
        part = written(sent.select("i", "j", "side", "tile", "dim", "low", "high", "nodes", "copies", "v").repartition(n_tasks, "i", "j").sortWithinPartitions("i", "j", "side", "tile")
                       .mapInArrow(_compare(axes, threshold, width, kind), "kind byte, a long, b long"), "vector-links")
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], "kind byte, a long, b long") if found is None else found


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    # single precision holds what it came from; else components stay in double
    single = vectors.schema[vec_col].dataType.elementType in (FloatType(), ByteType(), ShortType())
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = written(vectors.select(F.col(id_col).alias("vec_id"), F.when(usable, F.col(vec_col).cast(f"array<{element}>")).alias("v"),
                                  F.when(usable, F.xxhash64(v)).alias("node")), "vectors")
    nodes = (rows.where("v is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.first("v").alias("v")))
    nodes = written(nodes, "vector-nodes")

    size = nodes.agg(F.count("*").alias("n")).first()["n"]
    share = min(1.0, SAMPLE / max(size, 1))
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(11), "node"), 11) / F.lit(float(1 << 53))
    sample = nodes.where(lot < share).select("v").limit(2 * SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    axes = {d: principal_axes(_unit(np.array(x))) for d, x in by_dim.items() if d > 1 and len(x) >= d}

    n_tiles = max(1, -(-size // TILE))
    tiles = written(nodes.select("node", "copies", "v")
                    .mapInArrow(_turn(axes), f"node long, copies long, v array<{element}>, dim int, first double")
                    .repartitionByRange(n_tiles, "dim", "first", "node").sortWithinPartitions("dim", "first", "node")
                    .mapInArrow(_pack(kind), TILE_SCHEMA), "vector-tiles")
    found = _links(tiles, size, axes, threshold, kind)
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    components = connected_components(found.where("kind = 1").select("a", "b"))
    placed = (nodes.select("node", "copies", "vec_id").join(links, F.col("node") == F.col("a"), "left")
              .join(components, "node", "left")
              .select("node", "vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "node").alias("component")))
    placed = written(placed, "vector-components")
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = written(placed.join(least, "component").select("node", "n_links", "component_id"), "vector-results")
    linked = rows.where("v is not null").select("vec_id", "node").join(known, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
