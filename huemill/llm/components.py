"""Connected components of a graph given as edges, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huemill.llm.common import shared_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); the component is the least node reachable.

    Each round a node takes the least label among its own and its neighbours', then the label of
    that label; labels only fall, and the rounds end when none does. A hot node's labels are
    reduced before the shuffle, and its edges are a skewed join that adaptive execution splits.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = shared_checkpoint(both.distinct())
    labels = shared_checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = shared_checkpoint(lower.join(jump, F.col("c") == F.col("via")).select("node", F.least("c", "far").alias("component"), "old"))
        moved = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
