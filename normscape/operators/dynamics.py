"""Time series along a text: windows partition by trajectory, which is small; a node's history is cut by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normscape.functions import vectors as V
from normscape.operators.weights import join_groups
from normscape.sources.shared import settled


def dynamics(series: DataFrame) -> DataFrame:
    """(traj_idx, arm, k, pull, drift, potential, effective) of (traj_idx, arm, k, attunement, default)."""
    w = Window.partitionBy("traj_idx").orderBy("k")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = series.withColumn("__first", F.first("default").over(all_)).withColumn("__last", F.last("attunement").over(all_))
    d, a = F.col("default"), F.col("attunement")
    effective = F.when(F.size(d) > 0, V.effective_structures(d)).otherwise(1.0)
    return rows.select("traj_idx", "arm", "k", V.normalized_norm(d).alias("pull"), V.normalized_deviance(a, F.col("__first")).alias("drift"), V.normalized_deviance(F.col("__last"), d).alias("potential"), effective.alias("effective"))


def system_default(samples: DataFrame) -> DataFrame:
    """(traj_idx, k, struct_idx, value): mean over the continuations at each position."""
    return samples.select("traj_idx", "k", F.posexplode("system").alias("struct_idx", "x")).groupBy("traj_idx", "k", "struct_idx").agg(F.avg("x").alias("value"))


def running_stats(samples: DataFrame) -> DataFrame:
    """(node, i, n, mean, std) after each sample of (node, i, x); null x count as none.

    Samples are sorted into range partitions. A partition has its own running moments, and takes in those of all
    partitions before, merged from a row a node and partition; so a node's history may fill any number of tasks.
    """
    part = settled(samples.select("node", "i", "x").repartitionByRange("node", "i").withColumn("__part", F.spark_partition_id()))
    own = moments(part, ["__part", "node"])
    whole = Window.partitionBy("node")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # means of partitions are merged around the node's mean, so that no large squares cancel
    centre = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    off = own.withColumn("__c", centre).withColumn("__d", F.coalesce(F.col("mean") - F.col("__c"), F.lit(0.0)))
    total = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0.0))
    sums = off.select("__part", "node", "__c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), total(F.col("n") * F.col("__d")).alias("__s"), total(F.coalesce("m2", F.lit(0.0)) + F.col("n") * F.col("__d") * F.col("__d")).alias("__q"))
    shift = F.when(F.col("n0") > 0, F.col("__s") / F.col("n0")).otherwise(0.0)
    sums = sums.select("__part", "node", "n0", (F.col("__c") + shift).alias("mean0"), (F.col("__q") - F.col("__s") * shift).alias("m20"))
    upto = Window.partitionBy("__part", "node").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    here = part.select("__part", "node", "i", F.count("x").over(upto).alias("n1"), F.avg("x").over(upto).alias("mean1"), F.var_pop("x").over(upto).alias("v1"))
    rows = join_groups(here, sums, ["__part", "node"])
    n, d = F.col("n0") + F.col("n1"), F.col("mean1") - F.col("mean0")
    first, last = F.col("n0") == 0, F.col("n1") == 0
    mean = F.when(last, F.when(~first, F.col("mean0"))).when(first, F.col("mean1")).otherwise(F.col("mean0") + d * F.col("n1") / n)
    variance = F.when(last, F.when(~first, F.col("m20") / F.col("n0"))).when(first, F.col("v1")).otherwise((F.col("m20") + F.col("v1") * F.col("n1") + d * d * F.col("n0") * F.col("n1") / n) / n)
    return rows.select("node", "i", n.alias("n"), mean.alias("mean"), F.sqrt(F.when(variance < 0, 0.0).otherwise(variance)).alias("std"))


def moments(samples: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    x = F.col(value)
    return samples.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merge_moments(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Moments (n, mean, m2) of both together; a key on one side only keeps its own."""
    y = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("n", "mean", "m2")])
    j = a.join(y, keys, "full")
    n1, n2 = F.coalesce("n", F.lit(0)), F.coalesce("n_b", F.lit(0))
    m1, m2, n = F.coalesce("mean", F.lit(0.0)), F.coalesce("mean_b", F.lit(0.0)), n1 + n2
    d = m2 - m1
    return j.select(*keys, n.alias("n"), (m1 + d * n2 / n).alias("mean"), (F.coalesce("m2", F.lit(0.0)) + F.coalesce("m2_b", F.lit(0.0)) + d * d * n1 * n2 / n).alias("m2"))


def series_long(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return table.unpivot(keys, metrics, "metric", "value")


def dynamics_by_arm(table: DataFrame) -> DataFrame:
    return table.groupBy("arm", "k").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in ("pull", "drift", "potential")])
