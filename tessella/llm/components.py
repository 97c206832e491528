"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``u``, ``v``); the label is the least node of the component.

    Each round takes the least label among a node's neighbours (an aggregation
    that combines before its shuffle, so that a hub costs no more than its
    edges) and then jumps to the label's own label, which makes long chains
    shrink by halves. Labels are written to the shared folder after each round.
    Edges with a null end are ignored; an empty edge list gives no rows.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v")
    both = materialize(edges.where("u <> v").union(edges.where("u <> v").select("v", "u")).distinct())
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    labels = labels.join(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")), "node", "left")
    labels = materialize(labels.select("node", F.least("node", F.coalesce("low", "node")).alias("label")))
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        lower = materialize(lower)
        of = lower.select(F.col("node").alias("low"), F.col("low").alias("far"))
        jumped = lower.join(of, "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved"))
        jumped = materialize(jumped)
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
