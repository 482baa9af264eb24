"""Connected components by DataFrame joins; no node, link or component goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, weights: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` are undirected links of nodes, ``weights(node, w)`` has one row for each node of a link.

    Returns ``(node, w_min)``: the smallest w of the node's component. Each round takes the least label among
    a node and its neighbours (a partial aggregate, so hubs are combined before the shuffle) and then the label's
    own label, which shortens long chains; it ends when a round changes nothing. Labels are pairs (w, node), so
    equal weights do no harm. Every round is a written table: a lost executor costs a re-read, not the lineage."""
    both = scratch.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    nodes = both.select(F.col("a").alias("node")).distinct().join(weights, "node").select("node", F.struct("w", "node").alias("label"))
    labels = scratch.put(nodes, "labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        least = scratch.put(seen.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "least")
        up = least.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        jumped = least.withColumn("root", F.col("label.node")).join(up, "root").select("node", F.least("label", "root_label").alias("label"))
        old = labels.select("node", F.col("label").alias("old"))
        new = scratch.put(jumped.join(old, "node").select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "jumped")
        moved = new.filter("moved").limit(1).count()
        scratch.free(labels, least)
        labels = new.drop("moved")
        labels._staged_at = new._staged_at
        if not moved:
            scratch.free(both)
            return labels.select("node", F.col("label.w").alias("w_min"))
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
