"""Judges, unions, attachments, sampling and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normscape.operators.ranking import ranked


def merge_judges(scores: DataFrame, n_judges: int) -> DataFrame:
    """(traj_idx, struct_idx, score): mean over judges for trajectories that all have scored; nulls skipped, all null 0."""
    full = scores.groupBy("traj_idx").agg(F.count_distinct("judge").alias("k")).where(F.col("k") == n_judges)
    return scores.join(full, "traj_idx", "left_semi").groupBy("traj_idx", "struct_idx").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"))


def merge_judges_greedy(scores: DataFrame, n_judges: int) -> DataFrame:
    """merge_judges() on the greedy rows of each arm (judge, arm, struct_idx, score): an arm a trajectory."""
    merged = merge_judges(scores.withColumnRenamed("arm", "traj_idx"), n_judges)
    return merged.withColumnRenamed("traj_idx", "arm")


def average_judges(responses: DataFrame, judges: list[str] | None = None) -> DataFrame:
    """(text, question, score[, a judge a column][, logprob]): null-safe mean; all null stays null.

    Responses with a logprob give its mean over the judges that have one.
    """
    cells = [F.avg(F.when(F.col("judge") == j, F.col("score"))).alias(j) for j in judges or []]
    sure = [F.avg("logprob").alias("logprob")] if "logprob" in responses.columns else []
    return responses.groupBy("text", "question").agg(F.avg("score").alias("score"), *cells, *sure)


def append_structures(scores: DataFrame, new: DataFrame, at: int) -> DataFrame:
    """New structures from index `at` on; those of scores from there move behind them."""
    width = new.agg(F.max("struct_idx") + 1).first()[0] or 0
    moved = scores.withColumn("struct_idx", F.when(F.col("struct_idx") >= at, F.col("struct_idx") + width).otherwise(F.col("struct_idx")))
    return moved.unionByName(new.withColumn("struct_idx", F.col("struct_idx") + at))


def attach_greedy(systems: DataFrame, greedy: DataFrame) -> DataFrame:
    own = greedy.withColumn("traj_idx", -1 - F.col("traj_idx")).withColumn("is_greedy", F.lit(True))
    return systems.withColumn("is_greedy", F.lit(False)).unionByName(own, allowMissingColumns=True)


def attach_tokens(systems: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Add tokens after the arm's prefill: trajectories (traj_idx, token_ids, arm_length)."""
    t = trajectories.select("traj_idx", F.slice("token_ids", F.col("arm_length") + 1, F.greatest(F.size("token_ids"), F.lit(1))).alias("tokens"))
    return systems.join(t, "traj_idx", "left")


def attach_prompts(rows: DataFrame, arms: DataFrame, shared: str) -> DataFrame:
    """Add each row's prompt: its arm's, else the shared one."""
    return rows.join(arms.select("arm", F.col("prompt").alias("__p")), "arm", "left").withColumn("prompt", F.coalesce("__p", F.lit(shared))).drop("__p")


def stratified_sample(rows: DataFrame, strata: list[str], per_cell: int, per_outer: int, order: str) -> DataFrame:
    """Two caps: per cell of all strata, then per value of the first; rows in the order of a column.

    A cell may hold most rows, so the first cap is an aggregation that keeps the smallest (map-side) before windows.
    """
    salt = F.pmod(F.xxhash64(order), F.lit(64))
    inner = Window.partitionBy(*strata, "__salt").orderBy(order)
    cell = Window.partitionBy(*strata).orderBy(order)
    outer = Window.partitionBy(strata[0]).orderBy(order)
    few = rows.withColumn("__salt", salt).withColumn("__r", F.row_number().over(inner)).where(F.col("__r") <= per_cell)
    few = few.withColumn("__r", F.row_number().over(cell)).where(F.col("__r") <= per_cell)
    return few.withColumn("__r", F.row_number().over(outer)).where(F.col("__r") <= per_outer).drop("__r", "__salt")


def equalize_and_union(a: DataFrame, b: DataFrame, group: str, order: str) -> DataFrame:
    """Per group as many rows of each side as the smaller side has, labelled (specified) and (associated)."""
    n = a.groupBy(group).count().join(b.groupBy(group).agg(F.count("*").alias("m")), group).select(group, F.least("count", "m").alias("__n"))
    first = lambda df: ranked(df.join(n, group), [group], [F.col(order)], "__r").where("__r <= __n").drop("__r", "__n")
    label = lambda df, s: first(df).withColumn("label", F.concat(F.col(group).cast("string"), F.lit(f" ({s})")))
    return label(a, "specified").unionByName(label(b, "associated"))


def extremal_rows(systems: DataFrame, n: int, missing: float = -1000.0) -> DataFrame:
    """Per arm n rows in turn from the lowest and the highest mean logprob: two top-n selections merged by rank.

    Each side keeps its n best per (arm, salt) first, so that no task sorts a whole arm.
    """
    value = F.coalesce(F.col("logprob"), F.lit(missing)) / F.greatest(F.col("n_tokens"), F.lit(1))
    rows = systems.withColumn("__v", value).withColumn("__salt", F.pmod(F.xxhash64("traj_idx"), F.lit(64)))

    def side(order: list) -> DataFrame:
        few = rows.withColumn("__r", F.row_number().over(Window.partitionBy("arm", "__salt").orderBy(*order))).where(F.col("__r") <= n)
        return few.withColumn("__r", F.row_number().over(Window.partitionBy("arm").orderBy(*order))).where(F.col("__r") <= n)

    low = side([F.col("__v"), F.col("traj_idx")]).withColumn("__k", 2 * F.col("__r") - 1)
    high = side([F.col("__v").desc(), F.col("traj_idx")]).withColumn("__k", 2 * F.col("__r"))
    both = low.unionByName(high)
    once = both.groupBy("arm", "traj_idx").agg(F.min("__k").alias("__k"))
    return once.withColumn("pick", F.row_number().over(Window.partitionBy("arm").orderBy("__k"))).where(F.col("pick") <= n).select("arm", "traj_idx", "pick")


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
