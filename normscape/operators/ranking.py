"""Running sums, ranks and medians of groups that may hold a third of all rows: no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normscape.operators.weights import arm_rows, join_groups, with_weight
from normscape.sources.shared import settled


def running(df: DataFrame, keys: list[str], order: list[Column], amount: Column, out: str) -> DataFrame:
    """Add out: the sum of amount over a group's rows up to and including this one, in the order given.

    Rows are sorted into range partitions, each adds up its own, and the sums of the partitions before are added: a
    row a group and partition. The order has to tell a group's rows apart; where it does not, ties are split at will.
    """
    part = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id())
    part = settled(part.withColumn("__amount", amount))
    here = Window.partitionBy("__part", *keys)
    upto = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy("__part", *keys).agg(F.sum("__amount").alias("__sum"))
    totals = totals.select("__part", *keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    rows = join_groups(part.withColumn("__own", F.sum("__amount").over(upto)), totals, ["__part", *keys])
    return rows.withColumn(out, F.col("__before") + F.col("__own")).drop("__part", "__amount", "__own", "__before")


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Add out: the place of a row in its group, from 1."""
    return running(df, keys, order, F.lit(1).cast("long"), out)


def medians(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """(keys.., out): the mean of the two middle values of each group, nulls left out; a group of nulls alone has null."""
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("__c"))
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    upto = running(counts.where(F.col(value).isNotNull()), keys, [F.col(value)], F.col("__c"), "__upto")
    rows = join_groups(upto.select(*keys, F.col(value).alias("__v"), "__c", "__upto"), sizes, keys)
    nulls = sizes.where("__n = 0").select(*keys, F.lit(None).cast(df.schema[value].dataType).alias("__v"), F.lit(0).cast("long").alias("__c"), F.lit(0).cast("long").alias("__upto"), "__n")
    rows = rows.unionByName(nulls)
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    at = lambda place: F.max(F.when((F.col("__upto") - F.col("__c") < place) & (place <= F.col("__upto")), F.col("__v")))
    return rows.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(out))


def ranked_weights(systems: DataFrame, method: str = "prob", out: str = "w") -> DataFrame:
    """Each row with its weight in the arm and its rank there, the largest first; ties in order of traj_idx."""
    return ranked(with_weight(systems, method, out=out), ["arm"], [F.col(out).desc(), F.col("traj_idx")])


def ranked_arm_rows(systems: DataFrame) -> DataFrame:
    """weights.arm_rows() with rank, the likeliest of an arm first."""
    return ranked(arm_rows(systems), ["arm"], [F.col("p_norm").desc(), F.col("traj_idx")])
