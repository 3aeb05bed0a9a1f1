"""Connected components of a link table, as iterated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.session import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node with a link, the smallest node it reaches.

    Each round takes the smallest label among the neighbours (a map-side
    combined minimum, so a node with very many links is no hot spot) and then
    jumps to the label's own label, which halves the distance to the root.
    Every round's labels are stored, so lineage stays short; it ends when no
    label changes."""
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    edges = materialize(pairs.union(pairs.select("y", "x")).distinct())
    labels = materialize(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near"))
                         .select("node", F.least("node", "near").alias("root")))
    while True:
        heard = (edges.join(labels.select(F.col("node").alias("y"), F.col("root").alias("said")), "y")
                 .groupBy(F.col("x").alias("node")).agg(F.min("said").alias("said")))
        low = labels.join(heard, "node").select("node", "root", F.least("root", "said").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = materialize(low.join(jump, "low").select("node", F.least("low", "far").alias("root"),
                                                         (F.least("low", "far") < F.col("root")).alias("moved")))
        labels = after.select("node", "root")
        if after.filter("moved").isEmpty():
            return labels
