"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): the label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label's own label, so long chains shrink by
    doubling.  Labels only fall; the loop ends when none does.  All steps are joins and minima with map-side partial results, and
    nothing but one count per round reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = staged(both, "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        new = own.join(up, F.col("low") == F.col("up"), "left").select(
            "node", F.least("low", "up_label").alias("label"), (F.least("low", "up_label") < F.col("label")).alias("fell")
        )
        new = staged(new, "labels")
        fell = new.where("fell").limit(1).count()
        labels = new.select("node", "label")
        if not fell:
            return labels
