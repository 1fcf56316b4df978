"""Connected components of an edge table, with tables only (no edge or label is collected)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b of type long) -> node, component (the smallest node reachable), for nodes with an edge.

    Each round a node takes the smallest label among its neighbours and hands it to its old
    label too, then every label is replaced by its own label; labels only fall, so equal sums
    mean that none changed. Rounds grow with the logarithm of the longest path. Both inputs of
    each join are written tables, so Spark can split a node with very many edges."""
    both = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
                   .union(edges.select(F.col(b), F.col(a)).where(F.col(a) != F.col(b))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    total = None
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low")))
        seen = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "low").alias("low"))
        offers = seen.select("node", "low").union(seen.where("low < component").select("component", "low"))
        hooked = written(offers.groupBy("node").agg(F.min("low").alias("component")), "labels")
        top = hooked.select(F.col("node").alias("root"), F.col("component").alias("next"))
        labels = written(hooked.join(top, hooked["component"] == top["root"])
                         .select("node", F.col("next").alias("component")), "labels")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == total or now is None:
            return labels
        total = now


def cross_pairs(entries: DataFrame, components: DataFrame, done: DataFrame, may, sums=(), enough=None) -> DataFrame:
    """Distinct pairs (a < b) of nodes of one list (``key``) in different components that ``may``
    link and are not in ``done``.

    ``entries``: key, node and what ``may(x, y)`` (a condition on two aliases) needs. ``sums`` aggregate
    over the lists that a pair shares, ``enough`` filters pairs by them. In each list
    the nodes outside the largest component meet all nodes of other components, so a large
    connected group costs one pass, not its square."""
    columns = [c for c in entries.columns if c != "node"]
    placed = written(entries.distinct().join(components, "node", "left")
                     .select("node", *columns, F.coalesce("component", "node").alias("component")), "placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = written(parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("largest"),
                                             F.count("*").alias("parts")).where("parts > 1").drop("parts"), "mixed")
    inside = written(placed.join(mixed, "key"), "inside")
    x, y = inside.where("component <> largest").alias("x"), inside.alias("y")
    once = (F.col("x.node") < F.col("y.node")) | (F.col("y.component") == F.col("y.largest"))
    found = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & may("x", "y"))
             .groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))
    found = found.agg(*(sums or [F.count("*")]))
    found = (enough(found) if enough else found).select("a", "b")
    return written(found.join(done, ["a", "b"], "left_anti"), "pairs")
