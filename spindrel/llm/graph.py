"""Connected components over an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) longs -> (node, label), label the smallest node of its component; nodes without an edge are left out, and so are edges with a null end.

    Each round, every node and its current root hook to the smallest label among the node's neighbours, and then
    labels jump to their labels' labels. Rounds end when the labels stand still, which the driver sees from
    one row of sums. Tables between rounds are in the shared folder. Labels are joined through plain exchanges
    on both sides, so that a label held by very many nodes is split by the adaptive skew join.
    """
    both = table(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())  # null ends go here, too
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    seen = None
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("there")), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("there").alias("there"))
        met = table(labels.join(near, "node"))
        roots = met.groupBy(F.col("label").alias("node")).agg(F.min("there").alias("to"))
        step = met.select("node", F.least("label", "there").alias("label"))
        hooked = table(step.join(roots, "node", "left").select("node", F.least("label", F.coalesce("to", "label")).alias("label")))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        old, labels = labels, table(hooked.join(up, "label").select("node", F.col("top").alias("label")))
        drop(old, met, hooked)
        now = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(20,0)"))).first()[0]
        if now == seen:
            drop(both)
            return labels
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
