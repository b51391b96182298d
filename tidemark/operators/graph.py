"""Groups of nodes that share keys, directly or through others, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.snapshots import settled


def linked(members: DataFrame) -> DataFrame:
    """node, label (the smallest node of its group) from rows (node, key). In a round each key takes the smallest label of its nodes, each node the smallest of its keys, and then the label of its
    label, so that a chain is halved each time. Hot keys are minima, which combine before they move."""
    members = settled(members.distinct())
    labels = settled(members.select("node", F.col("node").alias("label")).distinct())
    while True:
        least = members.join(labels, "node").groupBy("key").agg(F.min("label").alias("low"))
        lower = members.join(least, "key").groupBy("node").agg(F.min("low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = settled(lower.join(jump, "low", "left").select("node", F.least("low", "far").alias("label")))
        if after.join(labels, ["node", "label"], "left_anti").isEmpty():
            return after
        labels = after
