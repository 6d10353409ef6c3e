"""Connected components by label propagation with pointer jumping, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in links (a, b).

    Each round takes the smallest label among a node's neighbours, then that label's own label, so
    stars end after two rounds and chains after a logarithmic number. Sums per node are combined
    before the shuffle, so a hub is no hot group. Null ends and self links tell nothing; an empty
    table gives no rows. Labels are written to the shared folder each round."""
    links = links.where("a is not null and b is not null and a <> b")
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(both.a.alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node", "left").select("node", F.least("component", "near").alias("next"), F.col("component").alias("before"))
        # the label of the label, if that is smaller still
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        now = met.join(jump, F.col("next") == F.col("at"), "left").select("node", "before", F.least("next", "further").alias("component"))
        now = cut_lineage(now)
        done = now.where("component <> before").limit(1).count() == 0
        labels = now.select("node", "component")
        if done:
            return labels
