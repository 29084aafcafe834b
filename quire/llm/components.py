"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the least node that can be reached. Self-loops and repeated
    edges are allowed; no edges give no rows. Each round writes its labels to the shared folder; rounds grow with the
    logarithm of the longest chain."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), name="edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), name="labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("of_b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("of_near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "of_near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(least.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), name="labels")
        if not after.filter("label <> old").limit(1).count():
            return after.select("node", "label")
        labels = after.select("node", "label")
