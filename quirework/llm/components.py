"""Connected components by repeated joins: every vertex gets the smallest id it can reach.

Each round takes the smallest label among the neighbours and then jumps to the label of
that label, so the rounds grow with the logarithm of a component's length. A round is
written to the shared folder, which cuts the lineage; nothing is collected but one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.settle import discard, settle


def labels(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, label) for every node that has an edge."""
    both = settle(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).where("node <> other").distinct()
    )
    now = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(now.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        low = now.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = now.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = settle(
            low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), "was")
        )
        moved = new.where("label <> was").limit(1).count()
        discard(now)
        now = new
        if not moved:
            discard(both)
            return now.select("node", "label")
