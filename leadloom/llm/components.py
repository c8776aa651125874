"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node that has an edge.

    Each round takes the least label among a node and its neighbours, then
    the label of that label. Labels go to a table in the shared folder each
    round, so lineage stays short; rounds end when no label changes.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = written(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("component")))
    while True:
        near = (
            both.join(labels, both["y"] == labels["node"])
            .groupBy(F.col("x").alias("n"))
            .agg(F.min("component").alias("low"))
        )
        own = labels.join(near, labels["node"] == near["n"], "left").select("node", "component", F.least("component", "low").alias("low"))
        up = labels.select(F.col("node").alias("u"), F.col("component").alias("top"))
        jumped = own.join(up, own["low"] == up["u"], "left")
        new = written(jumped.select("node", F.least("low", "top").alias("component"), (F.least("low", "top") != F.col("component")).alias("changed")))
        changed = not new.filter("changed").isEmpty()
        labels = new.select("node", "component")
        if not changed:
            return labels
