"""Connected components of a table of links, by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm.staging import drop, stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b), a staged table; component is the least node of the group.

    Labels stay in a table; each pass is a few joins on it, and the driver sees only how many labels
    changed. A pass sets each label to the least one among neighbours and then to that label's label,
    so the passes grow with the logarithm of the longest path.
    """
    edges = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    moved = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).select("node", F.least("node", "component").alias("component"), F.lit(True).alias("moved")), "labels")
    while True:
        labels = moved.select("node", "component")
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        least = F.least("label", "further")
        before, moved = moved, stage(step.join(jump, "label", "left").select("node", least.alias("component"), (least != F.col("old")).alias("moved")), "labels")
        drop(before)
        if moved.where("moved").isEmpty():
            drop(edges)
            out = moved.select("node", "component")
            out._sqlloom_path = moved._sqlloom_path
            return out
