"""Connected components as DataFrames, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise


def _roots(parent: DataFrame) -> DataFrame:
    """Follow ``parent`` (node, parent; parent < node) to the root, doubling the steps each time."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = materialise(parent.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "jump")
        parent = step.select("node", "parent")
        if step.where("moved").isEmpty():
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node with an edge to another; the component is its smallest node.

    ``edges`` has two columns of one orderable type; direction, repeats and loops
    don't matter, nulls are ignored. Each round hooks every node to its smallest
    neighbour if that is smaller, jumps to the roots, and contracts the edges to
    roots; at least half the roots with an edge go each time. A hub is one group
    of a partially aggregated minimum, and one key of a join whose other side is
    unique. Rounds are cut by tables in the shared folder.
    """
    a, b = edges.columns
    ends = lambda df, x, y: df.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).where("hi <> lo").distinct()
    now = materialise(ends(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b), "edges")
    out = None
    while not now.isEmpty():
        root = _roots(now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")))
        x, y = (root.select(F.col("node").alias(n), F.col("parent").alias(f"{n}_root")) for n in ("hi", "lo"))
        now = now.join(x, "hi", "left").join(y, "lo", "left")
        now = materialise(ends(now, F.coalesce("hi_root", "hi"), F.coalesce("lo_root", "lo")), "edges")
        if out is None:
            out = root
        else:  # roots of before may have been hooked now
            later = root.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            out = out.join(later, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")).unionByName(root)
            out = materialise(out, "roots")
    if out is None:
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    tops = out.select(F.col("parent").alias("node"), "parent").distinct()
    return out.unionByName(tops).select("node", F.col("parent").alias("component"))
