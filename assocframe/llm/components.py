"""Connected components by spreading the smallest label, without a driver-side
graph: each round is a pair of joins on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assocframe.runtime import has_rows, materialise, release


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to a table (node, label, old): label is the smallest node that can be
    reached. Only nodes with a link are listed. Each round takes the least
    label among the neighbours and then the label of that label, so chains
    shorten by more than half."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        step = hooked.select("node", "label", "next").alias("h").join(labels.select(F.col("node").alias("root"), F.col("label").alias("far")), F.col("next") == F.col("root"), "left")
        new = materialise(step.select("node", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")), "labels")
        release(labels)
        labels = new
        if not has_rows(labels.where("old != label")):
            release(both)
            return labels
