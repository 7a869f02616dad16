"""Connected components of a distributed edge list, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; the component is its least node.

    Each round, a node takes the least label of its neighbours, then the label of its label. Every round's labels
    are written to the shared folder, so that a lost executor costs one round.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionAll(edges.select(F.col(b), F.col(a))).where("u <> v").distinct(), "edges")
    label = last = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(label, both.v == label.node).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        pulled = label.join(near, "node", "left").select("node", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        up = label.select(F.col("node").alias("next"), F.col("component").alias("above"))
        moved = pulled.join(up, "next", "left").select("node", F.least("next", "above").alias("component"), "old")
        moved = stored(moved, "labels")
        settled = moved.where("component <> old").isEmpty()
        discard(last)
        label, last = moved.select("node", "component"), moved
        if settled:
            discard(both)
            return label
