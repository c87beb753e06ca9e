"""Connected components of many small graphs, or of a large one, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huemill.session import materialised


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str, a: str = "a", b: str = "b") -> DataFrame:
    """(keys, node, component): of each node the least node that edges (keys, a, b) reach from it within its graph, itself included.

    A round gives each node the least label of its neighbours, and then the label of the node that this names, so that long
    chains halve. Rounds end when no label falls. All graphs go through the same rounds.
    """
    both = materialised(edges.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).unionByName(edges.select(*keys, F.col(b).alias("_a"), F.col(a).alias("_b"))).where("_a <> _b").distinct())
    labels = materialised(nodes.select(*keys, F.col(node).alias("_node")).distinct().withColumn("_label", F.col("_node")))
    while True:
        near = both.join(labels.withColumnRenamed("_node", "_b"), [*keys, "_b"]).groupBy(*keys, F.col("_a").alias("_node")).agg(F.min("_label").alias("_near"))
        lower = labels.join(near, [*keys, "_node"]).select(*keys, "_node", F.col("_label").alias("_old"), F.least("_label", "_near").alias("_low"))
        named = labels.select(*keys, F.col("_node").alias("_low"), F.col("_label").alias("_far"))
        new = materialised(lower.join(named, [*keys, "_low"]).select(*keys, "_node", "_old", F.least("_low", "_far").alias("_label")))
        if new.where("_old <> _label").isEmpty():
            break
        # nodes without an edge keep their own label, and need no further rounds
        labels = new.select(*keys, "_node", "_label")
    alone = nodes.select(*keys, F.col(node).alias("_node")).distinct().join(both.select(*keys, F.col("_a").alias("_node")).distinct(), [*keys, "_node"], "left_anti")
    return new.select(*keys, F.col("_node").alias(node), F.col("_label").alias("component")).unionByName(alone.select(*keys, F.col("_node").alias(node), F.col("_node").alias("component")))
