"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, for each node of the edges (a, b).

    Each round every node takes the smallest label among its neighbours', then its label's label, which halves
    the way on long chains. Labels are written between rounds. Hot nodes only ever meet in joins of two written
    tables, whose large partitions Spark splits, and in minima that are first taken where the rows are.
    Self-links and repeated edges do no harm; edges with a null end are passed over. No edges, no rows.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    while True:
        least = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = written(labels.join(least, labels["node"] == least["a"]).select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "labels")
        if not nearer.where("moved").limit(1).count():
            return labels
        up = nearer.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        labels = written(nearer.join(up, nearer["label"] == up["_n"], "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label")), "labels")
