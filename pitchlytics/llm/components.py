"""Connected components of a written edge table by joins and grouped minima.

Each node has a parent, at first itself. A round sets parents to the least grandparent seen
along an edge, for the node, for its parent, and for the node through its own grandparent
(FastSV). A hot node is a join key or a group key of a minimum, which splits and combines; no
neighbour list is ever gathered. Rounds write their parents to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlytics.storage import settle


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (least node of its component) for all nodes of ``edges`` (a, b).
    No edges give no rows; loops and repeated edges do no harm."""
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parent = settle(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        up = parent.select(F.col("node").alias("label"), F.col("label").alias("grand"))
        known = parent.join(up, "label").select("node", "label", "grand")
        seen = (
            both.join(known.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("least"))
        )
        near = known.join(seen, "node")
        least = F.least("least", "grand")
        # A parent's children are many, its new value one: a grouped minimum.
        told = near.select("node", least.alias("label"), F.col("label").alias("old")).unionByName(
            near.groupBy(F.col("label").alias("node")).agg(F.min("least").alias("label")).withColumn("old", F.lit(None).cast("long")))
        following = settle(told.groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")), "labels")
        parent = following.select("node", "label")
        if following.where("label <> old").isEmpty():
            return parent
