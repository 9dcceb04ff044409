"""Connected components of the links of many keys at once, within each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.plans.lineage import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for the nodes of ``links`` (``a``, ``b``): the smallest node that is linked to it, directly or not.

    Labels spread over the links and jump along labels, so the rounds grow with the logarithm of the longest way. A round
    is two joins on a node or its label; a node with very many links only meets the smallest label of each neighbour.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = labels.select(F.col("node").alias("b"), "label")
        seen = both.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = labels.join(seen, "node").join(jump, "label", "left")
        after = cut(after.select("node", F.col("label").alias("old"), F.least("label", "seen", "far").alias("label")))
        labels = after.select("node", "label")
        if after.where("label < old").isEmpty():
            return labels
