"""Connected components by minimum labels and pointer jumping, written to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``x, y``); the label is the smallest node reachable.

    A node of any degree is reduced by partial aggregation; nothing is gathered. Rounds are at most
    logarithmic in long chains, because labels also jump to their label's label.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    both.where("x <> y").distinct().write.parquet(path)
    both = spark.read.parquet(path)
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label"))
    while True:
        path = scratch_path(spark, "labels")
        labels.withColumn("moved", F.lit(True)).write.parquet(path) if "moved" not in labels.columns else labels.write.parquet(path)
        held = spark.read.parquet(path)
        if held.where("moved").isEmpty():
            return held.select("node", "label")
        near = both.join(held.select(F.col("node").alias("y"), F.col("label").alias("other")), "y").groupBy(F.col("x").alias("node")).agg(F.min("other").alias("other"))
        stepped = held.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("step"))
        jump = held.select(F.col("node").alias("step"), F.col("label").alias("jumped"))
        labels = stepped.join(jump, "step").select("node", F.least("step", "jumped").alias("label"), (F.least("step", "jumped") != F.col("old")).alias("moved"))
