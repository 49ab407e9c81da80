"""Connected components by contraction: roots hook to their smallest neighbour until no edge joins two roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normscape.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): for each id of an edge the smallest id that it reaches.

    Each round maps the edges through the labels so far, and every root takes its smallest neighbouring root if that
    is smaller; the rounds needed grow with the logarithm of a component's size, not with its diameter. Rounds are
    cut by tables in the shared folder. Self-loops only name their id.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    left = saved(edges.where("a <> b").distinct(), "edges")
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("up")).where("up < a").select(F.col("a").alias("root"), "up")
        parents = saved(parents, "parents")
        if parents.isEmpty():
            return labels
        # two hops at once: a parent's own parent, where it has one
        above = parents.select(F.col("root").alias("up"), F.col("up").alias("top"))
        parents = parents.join(above, "up", "left").select("root", F.coalesce("top", "up").alias("up"))
        parents = saved(parents, "parents2")
        labels = labels.join(parents, labels["component"] == parents["root"], "left").select("id", F.coalesce("up", "component").alias("component"))
        labels = saved(labels, "labels")
        for end in ("a", "b"):
            moved = parents.select(F.col("root").alias(end), F.col("up").alias("__up"))
            left = left.join(moved, end, "left").withColumn(end, F.coalesce("__up", end)).drop("__up")
        left = saved(left.where("a <> b").distinct(), "edges")
