"""Connected components by smallest label with pointer jumping; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the smallest node of its component) for every node of `edges`; any orderable node type.

    A round takes the smallest label among neighbours and then the label of that label, so chains halve. It ends
    when a round changes nothing; the only thing sent to the driver is the number of changed labels.
    """
    both = stored(
        edges.select(F.col(a).alias("node"), F.col(b).alias("near")).union(edges.select(F.col(b), F.col(a))).filter("node <> near").distinct(),
        "links",
    )
    labels = stored(both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        own = labels.select(F.col("node").alias("near"), F.col("label").alias("near_label"))
        best = both.join(own, "near").groupBy("node").agg(F.min("near_label").alias("low"))
        near = labels.join(best, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        new = stored(near.join(up, "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("label")), "labels")
        changed = new.filter("label <> old").count()
        labels = new.select("node", "label")
        if not changed:
            return labels
