"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of (src, dst) edges; the component is the smallest id in it.

    Neighbour minima are partially aggregated, so a hub costs one row per task. Each round also follows the label's
    own label, so long chains need logarithmically many rounds. Lineage is cut at the shared checkpoint folder.
    """
    e = edges.where("src <> dst")
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    e = checkpointed(e.select(F.inline(F.array(way("src", "dst"), way("dst", "src")))).distinct())  # edges are made once
    labels = checkpointed(e.groupBy("src").agg(F.min("dst").alias("m")).select(
        F.col("src").alias("id"), F.least("src", "m").alias("label")))
    for _ in range(max_rounds):
        near = e.join(labels, e["dst"] == labels["id"]).groupBy("src").agg(F.min("label").alias("m"))
        grown = labels.join(near, labels["id"] == near["src"]).select("id", F.col("label").alias("old"),
                                                                      F.least("label", "m").alias("label"))
        parent = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = checkpointed(grown.join(parent, "label", "left").select(
            "id", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def with_components(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Attach `component` to every node; a node without edges is its own component."""
    c = components(edges).withColumnRenamed("id", key)
    return nodes.drop("component").join(c, key, "left").withColumn("component", F.coalesce("component", key))


def merge_components(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Second pass: join whole components along edges between components."""
    up = components(edges).select(F.col("id").alias("component"), F.col("component").alias("up"))
    return items.join(up, "component", "left").withColumn("component", F.coalesce("up", "component")).drop("up")
