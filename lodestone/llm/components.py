"""Connected components of a graph in a DataFrame, by passing on the least label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and label (the least node of its component) of each node in edges (a, b: any comparable type, no nulls).

    Each round a node takes the least label among its neighbours, then the label of its label, so long chains shrink by
    halves. Each round's labels are materialised in the shared folder; only a count of changes comes back.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("least")).withColumnRenamed("a", "node")
        passed = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = cut(passed.join(jump, "label", "left").select("node", "before", F.coalesce("further", "label").alias("label")))
        changed = after.where("label <> before").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
