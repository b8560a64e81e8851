"""Connected components by label exchange, written out each round so that plans stay short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import delete_table, written_table


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Smallest node id of the component of every node; edges are undirected.

    Each round lets every node take the least label among its neighbours and then jumps to its
    label's own label, so the number of rounds grows with the logarithm of the longest path.
    """
    both = edges.select(F.col(left).alias("node"), F.col(right).alias("other")).unionByName(
        edges.select(F.col(right).alias("node"), F.col(left).alias("other"))
    ).distinct()
    spark = edges.sparkSession
    both, edge_path = written_table(both)
    labels, path = written_table(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lowered, low_path = written_table(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        delete_table(spark, path)
        root = lowered.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels, path = written_table(lowered.join(root, "label").select("node", F.col("root").alias("label"), "moved"))
        delete_table(spark, low_path)
        if labels.where("moved").isEmpty():
            delete_table(spark, edge_path)
            return labels.drop("moved")
        labels = labels.drop("moved")
