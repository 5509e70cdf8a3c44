"""Connected components of a graph given by its edges, by repeated min-label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); a component is named by its smallest node.

    Each round hooks every node's label to the smallest label near it, and then each label to its own label, which halves the
    paths of labels, so that the rounds grow with the logarithm of the longest chain. A giant component is one label of many
    nodes: labels are looked up once each, and those that change, which are ever fewer, are joined with the nodes from
    results that are written, so that a hot label's nodes can be dealt to several tasks.
    Loops are harmless, repeated edges too; without edges there are no rows.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels.node == near.a, "left").select("node", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        hooked = settle(hooked)
        if hooked.filter("moved").isEmpty():
            return hooked.select("node", "component")
        tops = hooked.select(F.col("component").alias("top")).distinct()
        above = hooked.filter("node <> component").select("node", F.col("component").alias("above"))
        changed = settle(tops.join(above, tops.top == above.node).select("top", "above"))
        labels = settle(hooked.join(changed, hooked.component == changed.top, "left").select("node", F.coalesce("above", "component").alias("component")))
