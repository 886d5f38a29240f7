"""Connected components of a link table, by Spark joins: neighbours' smallest label, then a jump to that label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node of ``links``: the smallest node it reaches.

    Rounds grow with the logarithm of the longest shortest path. Labels only fall, each round is staged in the shared
    folder, and a hub's links are combined before they are shuffled.
    """
    both = stage(links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).where("node <> other").distinct(), "links")
    labels = stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        nearer = labels.join(seen, "node").select("node", F.least("label", "seen").alias("near"), F.col("label").alias("old"))
        jumped = nearer.join(nearer.select(F.col("node").alias("near"), F.col("near").alias("far")), "near", "left")
        new = stage(jumped.select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "old"), "labels")
        changed = new.where("label <> old").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(both)
            return labels.select("node", "label")
