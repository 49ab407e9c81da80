"""Token sequences with their logits as long tables: ranks, renormalised log-probabilities, entropies of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normscape.functions.vectors import EPS, INF, renyi_entropy
from normscape.operators.ranking import ranked
from normscape.operators.weights import join_groups

_AT = ["traj_idx", "pos"]


def _chosen(chosen: DataFrame, logits: DataFrame) -> DataFrame:
    """Logits (traj_idx, pos, token, logit) of the positions of chosen (traj_idx, pos, token), with is_chosen."""
    picked = chosen.select(*_AT, F.col("token").alias("__token"))
    return logits.join(picked, _AT).withColumn("is_chosen", F.col("token") == F.col("__token")).drop("__token")


def token_ranks(chosen: DataFrame, logits: DataFrame) -> DataFrame:
    """(traj_idx, pos, rank): 1 + the number of tokens with a larger logit; 1 where a position has no logits.

    A position's vocabulary is the group, which does not grow with the data.
    """
    own = F.max(F.when(F.col("is_chosen"), F.col("logit"))).over(Window.partitionBy(*_AT))
    ranks = _chosen(chosen, logits).withColumn("__own", own).groupBy(*_AT).agg((F.sum((F.col("logit") > F.col("__own")).cast("long")) + 1).alias("rank"))
    return chosen.select(*_AT).join(ranks, _AT, "left").fillna(1, ["rank"])


def worst_ranks(ranks: DataFrame) -> DataFrame:
    """(traj_idx, worst_rank, worst_pos): the largest rank of each sequence and the first position that has it."""
    return ranks.groupBy("traj_idx").agg(F.max("rank").alias("worst_rank"), F.max(F.struct("rank", (-F.col("pos")).alias("p"))).alias("__b")).select("traj_idx", "worst_rank", (-F.col("__b.p")).alias("worst_pos"))


def top_p_logprobs(chosen: DataFrame, logits: DataFrame, p: int = 100) -> DataFrame:
    """(traj_idx, pos, logprob): of the chosen token among a position's p largest logits; -infinity outside them.

    Ties at the edge go to the smaller token; a position without logits has 0.
    """
    w = Window.partitionBy(*_AT).orderBy(F.desc("logit"), "token")
    kept = _chosen(chosen, logits).withColumn("__r", F.row_number().over(w)).withColumn("__top", F.first("logit").over(w)).where(F.col("__r") <= p)
    own = F.max(F.when(F.col("is_chosen"), F.col("logit")))
    total = F.first("__top") + F.ln(F.sum(F.exp(F.col("logit") - F.col("__top"))))
    scored = kept.groupBy(*_AT).agg(F.coalesce(own - total, F.lit(-INF)).alias("logprob"))
    return chosen.select(*_AT).join(scored, _AT, "left").fillna(0.0, ["logprob"])


def position_entropy(logits: DataFrame, top: int = 3) -> DataFrame:
    """(traj_idx, pos, entropy, top_token, top_prob, top_mass) of the softmax of a position's logits."""
    w = Window.partitionBy(*_AT)
    s = logits.withColumn("p", F.exp("logit") / F.sum(F.exp("logit")).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("logit"), "token")))
    return s.groupBy(*_AT).agg(renyi_entropy(F.col("p"), 1).alias("entropy"), F.max(F.when(F.col("r") == 1, F.col("token"))).alias("top_token"), F.max("p").alias("top_prob"), F.sum(F.when(F.col("r") <= top, F.col("p"))).alias("top_mass"))


def decision_points(alternatives: DataFrame, orders: tuple = (0, 1, 2)) -> DataFrame:
    """(traj_idx, pos, entropy_<q>, diversity_<q>, concentration_<q>) of each position's alternatives (.., prob), normalised."""
    w = Window.partitionBy(*_AT)
    p = alternatives.withColumn("__p", F.col("prob") / F.sum("prob").over(w))
    cols = [renyi_entropy(F.col("__p"), q).alias(f"entropy_{q}") for q in orders]
    out = p.groupBy(*_AT).agg(*cols)
    for q in orders:
        d = F.exp(f"entropy_{q}")
        out = out.withColumn(f"diversity_{q}", d).withColumn(f"concentration_{q}", F.when(d > EPS, 1 / d).otherwise(INF))
    return out


def entropy_stats(entropies: DataFrame, threshold: float, keys: tuple = ("traj_idx",)) -> DataFrame:
    """(keys.., n, lo, hi, mean, std, p25, p50, p75, n_high) of entropies (keys.., pos, entropy).

    A percentile is the value at place n * f of the sorted ones, rounded down; fewer than 4 values: lo and hi stand
    for the quarters, and a single one for the middle.
    """
    keys, e = list(keys), F.col("entropy")
    stats = entropies.groupBy(*keys).agg(F.count(e).alias("n"), F.min(e).alias("lo"), F.max(e).alias("hi"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.sum((e >= threshold).cast("long")).alias("n_high"))
    rows = join_groups(ranked(entropies.select(*keys, "pos", "entropy"), keys, [e, F.col("pos")], "__r"), stats.select(*keys, "n"), keys)
    at = lambda f: F.max(F.when(F.col("__r") == F.floor(F.col("n") * f) + 1, e))
    parts = rows.groupBy(*keys).agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    n = F.col("n")
    p = [F.when(n >= 4, F.col("q1")).otherwise(F.col("lo")).alias("p25"), F.when(n >= 2, F.col("q2")).otherwise(F.col("mean")).alias("p50"), F.when(n >= 4, F.col("q3")).otherwise(F.col("hi")).alias("p75")]
    return join_groups(stats, parts, keys).select(*keys, "n", "lo", "hi", "mean", "std", *p, "n_high")


def entropy_histogram(entropies: DataFrame, bins: int = 8, keys: tuple = ("traj_idx",)) -> DataFrame:
    """(keys.., bin, low, high, n): equal bins from the smallest to the largest entropy, the last one closed; empty bins have none."""
    keys, e = list(keys), F.col("entropy")
    edges = entropies.groupBy(*keys).agg(F.min(e).alias("__lo"), F.max(e).alias("__hi"))
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins).otherwise(1.0)
    rows = join_groups(entropies, edges.withColumn("__w", width), keys)
    place = sum((e >= F.col("__lo") + i * F.col("__w")).cast("int") for i in range(1, bins))
    rows = rows.withColumn("bin", place).groupBy(*keys, "bin").agg(F.first("__lo").alias("__lo"), F.first("__w").alias("__w"), F.count("*").alias("n"))
    return rows.select(*keys, "bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("low"), (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("high"), "n")
