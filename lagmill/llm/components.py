"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.session import scratch_folder


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node that links reach.

    Each round takes the smallest label of the neighbours, then the label of that label, so paths shorten by half. Labels are
    written to the shared folder after each round; the driver only learns how many changed. No links give no rows.
    """
    spark = links.sparkSession
    at = scratch_folder(spark, "links")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both.where("a is not null and b is not null").distinct().write.parquet(at)
    edges = spark.read.parquet(at)
    path = scratch_folder(spark, "labels")
    edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label").write.parquet(path)
    while True:
        labels = spark.read.parquet(path)
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("beyond", "label")).alias("label"))
        path = scratch_folder(spark, "labels")
        moved.write.parquet(path)
        if spark.read.parquet(path).where("old <> label").isEmpty():
            return spark.read.parquet(path).select("node", "label")
