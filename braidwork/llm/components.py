"""Connected components over stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import discard, store


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Stored rows (node, label): label is the smallest node that edges (a, b) lead to; nodes without edges have no row.

    Labels start as nodes. In each round a node takes the smallest label among its neighbours, and then the
    label of its label, so chains halve. Every round is a table in the shared folder; a node with very many
    neighbours only meets partial minima.
    """
    pairs = edges.select("a", "b").where("a != b")
    both = store(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels, before = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), None
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parent = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = hooked.join(parent, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        after = store(jumped, "component-labels")
        if before is not None:
            discard(before)
        labels, before = after.select("node", "label"), after
        if after.where("old != label").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    discard(both)
    return labels
