"""Connected components of edges by hooking to the smallest neighbour and jumping to its label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opswell.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of the edges (a, b): root is the smallest node that can be reached.

    Every round is written to the shared folder; the rounds end when no label
    changes. A node with very many neighbours is pre-aggregated before the shuffle.
    """
    ends = edges.select("a", "b").union(edges.select("b", "a"))
    labels = settle(ends.groupBy("a").agg(F.min("b").alias("_low")).select(F.col("a").alias("node"), F.least("a", "_low").alias("root")))
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("root").alias("_theirs"))
        low = ends.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("_theirs").alias("_low"))
        hooked = labels.join(low, "node").select("node", "root", F.least("root", "_low").alias("_next"))
        jump = labels.select(F.col("node").alias("_next"), F.col("root").alias("_far"))
        after = settle(hooked.join(jump, "_next").select("node", F.least("_next", "_far").alias("root"), (F.least("_next", "_far") != F.col("root")).alias("_changed")))
        labels = after.select("node", "root")
        if after.filter("_changed").isEmpty():
            return labels
