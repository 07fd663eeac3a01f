"""Connected components by label propagation with pointer jumping, in DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for each end of the edges ``a, b``.

    A round takes the smallest label of the neighbourhood and then that label's own label; rounds grow with the logarithm
    of the longest path, and only the number of changes reaches the driver.
    """
    pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = materialise(pairs.distinct(), "component-edges")
    state = materialise(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "component-start")
    while True:
        offered = pairs.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        lower = materialise(state.join(offered, "node").select("node", F.col("label").alias("was"), F.least("label", "offer").alias("mid")), "component-lower")
        jump = lower.select(F.col("node").alias("mid"), F.col("mid").alias("label"))
        after = materialise(lower.join(jump, "mid").select("node", "was", "label"), "component-round")
        state = after.select("node", "label")
        if after.where("was <> label").isEmpty():
            return state.select(F.col("node").alias("id"), F.col("label").alias("component"))
