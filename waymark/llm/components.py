"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge: label is the least node of its component.

    Each round every node takes the least label among its neighbours and itself,
    then the label of that label; rounds end when nothing changes, after about
    the logarithm of a component's diameter. Every round is a written table.
    A node with very many edges is one key only after a partial minimum in each task.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("m"))
        met = labels.join(near, labels.node == near.x, "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("next"))
        hop = labels.select(F.col("node").alias("h"), F.col("label").alias("hl"))
        jumped = met.join(hop, met.next == hop.h, "left").select("node", F.col("label").alias("was"), F.least("next", F.coalesce("hl", "next")).alias("label"))
        new = materialize(jumped, "labels")
        changed = new.where("label <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels
