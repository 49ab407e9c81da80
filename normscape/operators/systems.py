"""From scores to systems, and per-arm summaries of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normscape.functions.vectors import INF


def to_systems(scores: DataFrame, n_structures: int) -> DataFrame:
    """(traj_idx, arm, system): bundle means with null as 0, missing structures 0, in structure order."""
    cells = [F.coalesce(F.avg(F.when(F.col("struct_idx") == i, F.coalesce("score", F.lit(0.0)))), F.lit(0.0)) for i in range(n_structures)]
    return scores.groupBy("traj_idx", "arm").agg(F.array(*cells).alias("system"))


def structure_dim(items: DataFrame) -> DataFrame:
    """(method, struct_idx, label, question_count, description) of (method, prefix, position, questions array)."""
    cut = F.transform("questions", lambda q: F.substring(q, 1, 60))
    return items.select("method", "position", F.concat("prefix", (F.col("position") + 1).cast("string")).alias("label"), F.size("questions").alias("question_count"), F.concat_ws(" + ", cut).alias("description"))


def structure_offsets(items: DataFrame, methods: list[str]) -> DataFrame:
    """structure_dim() with method_offset and struct_idx: structures are counted over the methods in the order given.

    Methods without structures take no numbers; those not in the list have no rows. A configuration: a row a structure.
    """
    sizes = items.groupBy("method").agg(F.max("position").alias("__last"))
    place = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    before = Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)  # a row a method
    offsets = sizes.withColumn("__place", place).where("__place > 0").select("method", F.coalesce(F.sum(F.col("__last") + 1).over(before), F.lit(0)).alias("method_offset"))
    return structure_dim(items).join(offsets, "method").withColumn("struct_idx", F.col("method_offset") + F.col("position"))


def arm_structure_means(scores: DataFrame) -> DataFrame:
    """(arm, struct_idx, item_idx, mean): nulls skipped; item_idx null is the pooled mean of a bundle."""
    return scores.groupingSets([["arm", "struct_idx", "item_idx"], ["arm", "struct_idx"]], "arm", "struct_idx", "item_idx").agg(F.avg("score").alias("mean"))


def arm_structure_stats(scores: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return scores.groupBy("arm", "struct_idx").agg(z(F.avg("score")).alias("mean"), z(F.stddev_pop("score")).alias("std"), z(F.min("score")).alias("lo"), z(F.max("score")).alias("hi"))


def structure_overall_means(scores: DataFrame) -> DataFrame:
    """(struct_idx, mean): the mean of item means."""
    return scores.groupBy("struct_idx", "item_idx").agg(F.avg("score").alias("m")).groupBy("struct_idx").agg(F.avg("m").alias("mean"))


def group_by_arm(rows: DataFrame, default: str = "trunk") -> DataFrame:
    return rows.groupBy(F.coalesce("arm", F.lit(default)).alias("arm")).agg(F.count("*").alias("n"))


def aggregate(x: Column, how: str) -> Column:
    """mean, max, sum, median or min of a group; nothing gives -infinity."""
    return F.coalesce({"mean": F.avg, "max": F.max, "sum": F.sum, "median": F.median, "min": F.min}[how](x), F.lit(-INF))


def arm_counts(rows: DataFrame) -> DataFrame:
    """(arm, n, first_row), for order by first appearance."""
    return rows.groupBy("arm").agg(F.count("*").alias("n"), F.min("traj_idx").alias("first_row"))


def structure_breakdown(scores: DataFrame, arms: list[str]) -> DataFrame:
    """(struct_idx, item_idx, an arm a column): means in percent, missing 0."""
    return scores.groupBy("struct_idx", "item_idx").pivot("arm", arms).agg(100 * F.avg("score")).fillna(0.0)


def point_masses(scores: DataFrame) -> DataFrame:
    """(arm, struct_idx, p0, p1, interior, mean) of the finite scores."""
    x = F.col("score")
    ok = scores.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF))
    share = lambda c: F.avg(c.cast("double"))
    return ok.groupBy("arm", "struct_idx").agg(share(x <= 0).alias("p0"), share(x >= 1).alias("p1"), share((x > 0) & (x < 1)).alias("interior"), F.avg(x).alias("mean"))
