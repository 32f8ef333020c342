"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatward.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node of the component.

    A round takes the smallest label of a node's neighbours, then the label of that label, so chains shrink by doubling. Labels
    stay distributed; the driver sees one count a round. A hub of any degree is aggregated map-side and its join split.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        joined = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        stepped = stored(joined, "labels")
        up = stepped.select(F.col("node").alias("of"), F.col("label").alias("above"))
        jumped = stepped.join(up, stepped["label"] == up["of"], "left").select(
            "node", "was", F.least("label", F.coalesce("above", "label")).alias("label")
        )
        new = stored(jumped, "labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
