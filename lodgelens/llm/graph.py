"""Connected components of a table of links, as Spark joins over stored steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.session import materialise


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each linked id: columns node, root.

    ``links`` has columns a and b in any order; loops, repeats and nulls are harmless. Each round
    joins every node with the labels of its neighbours, takes the least and then follows the label
    of that label, so the number of rounds grows with the logarithm of the longest chain. A label
    is sent once per link, so a node with many links (a star) is a long group for a plain minimum,
    which Spark combines before the shuffle. Every round is stored; nothing is collected.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = materialise(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b"))
    labels = materialise(least.select("node", F.least("node", "_b").alias("root")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        hooked = labels.join(seen, "node").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("_root"))
        # The root of a neighbour may itself have found a smaller root: follow it once.
        onward = hooked.select(F.col("node").alias("_root"), F.col("_root").alias("_next"))
        stepped = materialise(
            hooked.join(onward, "_root", "left").select("node", F.least("_root", F.coalesce("_next", "_root")).alias("root"), "_old"),
            "labels",
        )
        changed = stepped.where("root <> _old").limit(1).count()
        labels = stepped.select("node", "root")
        if not changed:
            return labels
