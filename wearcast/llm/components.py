"""Connected components of a table of links, as least reachable node id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of links(a, b).

    Each round takes the least label among a node and its neighbours and then
    the label of that label, so long chains shorten by doubling.  Every round
    is one pre-aggregated join written to the shared folder.
    """
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    now = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    k = 0
    while True:
        near = (both.join(now, both.b == now.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = now.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = now.select(F.col("node").alias("to"), F.col("label").alias("far"))
        k += 1
        after = scratch.save(step.join(jump, "to", "left").select(
            "node", F.least("to", F.coalesce("far", "to")).alias("label"),
            (F.least("to", F.coalesce("far", "to")) < F.col("label")).alias("moved")), f"{name}-{k}")
        moved = not after.where("moved").isEmpty()
        scratch.drop(f"{name}-{k - 1}")
        now = after.select("node", "label")
        if not moved:
            scratch.drop(f"{name}-links")
            return now
