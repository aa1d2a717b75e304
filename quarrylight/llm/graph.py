"""Connected components of an edge table by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import settle


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges(a, b), for nodes that have an edge.

    Every round takes the smallest label among neighbours, one combining aggregate, then follows the label's own label,
    so chains halve. Rounds are settled in the shared folder. Only one number, how many labels changed, reaches the
    driver. A hub's edges meet in a sort-merge join that AQE splits and an aggregate that combines map-side.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_near"))
        hooked = labels.join(seen, F.col("node") == F.col("a"), "left").select(
            "node", F.col("component").alias("_was"), F.least("component", "_near").alias("_now")
        )
        jump = labels.select(F.col("node").alias("_now"), F.col("component").alias("_next"))
        new = settle(hooked.join(jump, "_now", "left").select("node", "_was", F.least("_now", "_next").alias("component")), "labels")
        changed = not new.filter(F.col("component") != F.col("_was")).isEmpty()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
