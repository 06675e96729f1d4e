"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node.

    Each round takes the least label among a node's neighbours, then the label of that
    label, so the rounds grow with the logarithm of the diameter in practice.  Labels
    stay in Spark; the driver only learns whether a round changed any.  Hot nodes meet
    partial minima before the shuffle, and the join can be split by adaptive execution.
    Nulls in either column are dropped; no edges give no rows.
    """
    edges = edges.dropna().where("a <> b")
    both = table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("n")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, F.col("node") == F.col("n"), "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        after = table(near.join(jump, F.col("new") == F.col("at"), "left").select("node", "old", F.least("new", "far").alias("label")))
        changed = not after.where("old <> label").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def grow_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """known (node, component) after further edges (a, b) between its nodes.

    Edges are contracted to the components they join, so each round only works on what is new.
    """
    at = lambda n: known.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    joined = edges.join(at("a"), "a").join(at("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    moved = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return table(known.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component")))
