"""Connected components of identity graphs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{_folder(df.sparkSession).rstrip('/')}/waymark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    Labels take the least label of a neighbour and then that label's own label,
    so rounds grow with the logarithm of a chain's length.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = written(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("m"))
        met = labels.join(near, labels.node == near.x, "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("next"))
        hop = labels.select(F.col("node").alias("h"), F.col("component").alias("hc"))
        new = written(met.join(hop, met.next == hop.h, "left").select("node", "was", F.least("next", F.coalesce("hc", "next")).alias("component")))
        labels = new.drop("was")
        if new.where("component <> was").isEmpty():
            return labels
