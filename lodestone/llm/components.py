"""Connected components of a graph by repeated minima over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.stored import drop_stored, stored, stored_counting


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, component) of each node of `nodes` (key); component is the smallest key of its component.

    links: (a, b). In each round a node takes the smallest label around it, and then the label of the
    node that this label names, so paths shorten by halves; a round's labels are a table. Only
    counts come to the driver, and the write takes them. Rounds end when no label changes.
    """
    around = links.where("a <> b").select("a", "b").distinct()
    around = stored(around.union(around.select(F.col("b"), F.col("a"))).toDF("key", "other"), "around")
    linked = around.select("key").distinct()
    labels = stored(linked.withColumn("component", F.col("key")), "labels-0")
    k, changed = 0, 1
    while changed:
        k += 1
        near = around.join(labels.select(F.col("key").alias("other"), "component"), "other").groupBy("key").agg(F.min("component").alias("least"))
        lower = labels.join(near, "key").select("key", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        jump = lower.select(F.col("key").alias("component"), F.col("component").alias("beyond"))
        step = lower.join(jump, "component", "left").select("key", "was", F.least("component", F.coalesce("beyond", "component")).alias("component"))
        step, seen = stored_counting(step, f"labels-{k}", changed=F.count_if(F.col("component") != F.col("was")))
        drop_stored(labels)
        labels, changed = step.select("key", "component"), seen.get("changed", 0)
    drop_stored(around)
    return nodes.distinct().join(labels, "key", "left").select("key", F.coalesce("component", "key").alias("component"))
