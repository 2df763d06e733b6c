"""Connected components of an edge table, with checkpoints and no driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _flatten(parents: DataFrame) -> DataFrame:
    """Follow (node, root) pointers until every root points at itself; doubles the reach each time."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = stage(parents.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "cc-jump")
        moved = jumped.where("moved").limit(1).count()
        unstage(parents)
        path = jumped._ledgerline_path
        parents = jumped.drop("moved")
        parents._ledgerline_path = path
        if not moved:
            return parents


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (x, y); root is the smallest node of its component.

    Each round points every node at its smallest neighbour, flattens the
    pointers and contracts the edges.  Every component at least halves.
    """
    order = lambda e: e.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    left = stage(order(edges), "cc-edges")
    labels: DataFrame | None = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parents = stage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("root")), "cc-parents")
        parents = _flatten(parents)
        root = lambda name: parents.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))  # noqa: B023, E731
        after = stage(order(left.join(root("x"), "x").join(root("y"), "y").select(F.col("rx").alias("x"), F.col("ry").alias("y"))), "cc-edges")
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = stage(labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-labels")
        unstage(left)
        left = after
    return labels if labels is not None else left.select(F.col("x").alias("node"), F.col("y").alias("root"))
