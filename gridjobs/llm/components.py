"""Connected components of an edge table by label propagation with pointer jumping; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Each round every node takes the least label of its neighbours, then its label's own label, so long paths halve.
    Rounds end when nothing changes; every round is written to shared storage.
    """
    once = edges.select("a", "b").where("a <> b").distinct()
    both = materialize(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        hop = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        own = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = materialize(hop.join(own, "via").select("node", "was", F.least("via", "far").alias("component")), "labels")
        changed = new.where("component < was").limit(1).count()
        release(labels)
        kept = new.select("node", "component")
        kept.stored_at = new.stored_at
        labels = kept
        if not changed:
            release(both)
            return labels
