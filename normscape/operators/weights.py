"""Weights of systems within an arm: two aggregations with map-side combine and a join of a row an arm, no windows.

An arm may hold a third of all rows, so nothing here partitions rows by arm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normscape.functions.vectors import EPS, INF
from normscape.sources.shared import settled, small

LEAST_LOGPROB = -700.0


def join_groups(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a row a group back to rows, null keys included.

    stats is worked out here and now and broadcast where it is small, so that rows stay where they are: adaptive execution
    sees few partitions with rows on that side and would sort all rows of a group in one task.
    """
    renamed = small(settled(stats)).select([F.col(k).alias(f"__{k}") for k in keys] + [c for c in stats.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return df.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def _inv_ppl(lp: Column, n: Column) -> Column:
    return F.when((n > 0) & (lp > LEAST_LOGPROB), F.exp(lp / F.when(n > 0, n))).otherwise(0.0)


#: name -> raw weight of (logprob, n_tokens, the arm's largest logprob); weights are shares of the arm's sum.
RAW: dict[str, Callable[[Column, Column, Column], Column]] = {
    "prob": lambda lp, n, top: F.when(top > -INF, F.exp(lp - top)).otherwise(0.0),
    "inv-ppl": lambda lp, n, top: _inv_ppl(lp, n),
    "log-prob": lambda lp, n, top: lp,
    "log-inv-ppl": lambda lp, n, top: F.when(n > 0, lp / F.when(n > 0, n)).otherwise(lp),
    "uniform": lambda lp, n, top: F.lit(1.0),
}


def with_weights(systems: DataFrame, methods: list[str], keys: tuple = ("arm",), prefix: str = "w") -> DataFrame:
    """Add w0, w1, .. : for each method a weight that sums to 1 in each group.

    A sum of zero (or of no finite value) gives equal weights. All methods share one pass for the sums, and one more
    before it if a method needs the largest logprob; what they leave is a row a group, worked out here and now, so that
    the result reads its rows once.
    """
    keys, lp, n = list(keys), F.coalesce("logprob", F.lit(0.0)), F.coalesce("n_tokens", F.lit(0))
    df, top = systems, F.lit(0.0)
    if "prob" in methods:
        df = join_groups(df, df.groupBy(*keys).agg(F.max(lp).alias("__top")), keys)
        top = F.col("__top")
    for i, m in enumerate(methods):
        df = df.withColumn(f"__raw{i}", RAW[m](lp, n, top))
    sums = [F.sum(f"__raw{i}").alias(f"__sum{i}") for i in range(len(methods))]
    df = join_groups(df, df.groupBy(*keys).agg(*sums, F.count("*").alias("__n")), keys)
    for i in range(len(methods)):
        s = F.col(f"__sum{i}")
        usable = (s != 0) & ~F.isnan(s) & (F.abs(s) != INF)
        df = df.withColumn(f"{prefix}{i}", F.when(usable, F.col(f"__raw{i}") / F.when(usable, s)).otherwise(1.0 / F.col("__n")))
    return df.drop("__top", "__n", *[f"__{c}{i}" for i in range(len(methods)) for c in ("raw", "sum")])


def with_weight(systems: DataFrame, method: str = "inv-ppl", keys: tuple = ("arm",), out: str = "w") -> DataFrame:
    """Add the weight of one method as column `out`."""
    return with_weights(systems, [method], keys, "__w").withColumnRenamed("__w0", out)


def normalize(df: DataFrame, value: str, keys: tuple, out: str = "p") -> DataFrame:
    """value / sum within a group; negative values are an error, a sum below EPS gives equal shares, infinities share equally."""
    keys, v = list(keys), F.col(value)
    v = F.when(v < 0, F.raise_error(F.lit("negative value")).cast("double")).otherwise(v)
    stats = df.groupBy(*keys).agg(F.sum(v).alias("__sum"), F.count("*").alias("__n"), F.sum((v == INF).cast("int")).alias("__inf"))
    p = F.when(F.col("__inf") > 0, (F.col(value) == INF).cast("double") / F.col("__inf")).when(F.col("__sum") < EPS, 1.0 / F.col("__n")).otherwise(F.col(value) / F.when(F.col("__sum") >= EPS, F.col("__sum")))
    return join_groups(df, stats, keys).withColumn(out, p).drop("__sum", "__n", "__inf")


def escort(df: DataFrame, orders: list[float], p: str = "w", keys: tuple = ("arm",), prefix: str = "e") -> DataFrame:
    """Add columns e0, e1, .. : p^r / sum p^r within a group for each order r; p up to EPS is outside the support.

    r = 1 leaves p as it is, r = 0 is uniform over the support, +-infinity splits 1 among the largest or smallest.
    """
    keys, inside = list(keys), F.col(p) > EPS
    ln = F.ln(F.when(inside, F.col(p)))
    stats = df.groupBy(*keys).agg(F.max(ln).alias("__hi"), F.min(ln).alias("__lo"), F.count(ln).alias("__s"))
    df = join_groups(df, stats, keys)
    sums = {}
    for i, r in enumerate(orders):
        if r not in (0, 1):
            at = F.col("__hi" if r > 0 else "__lo")
            sums[i] = F.sum((ln == at).cast("int")) if abs(r) == INF else F.sum(F.exp(r * (ln - at)))
    if sums:
        df = join_groups(df, df.groupBy(*keys).agg(*[c.alias(f"__z{i}") for i, c in sums.items()]), keys)
    for i, r in enumerate(orders):
        at, z = F.col("__hi" if r > 0 else "__lo"), F.col(f"__z{i}") if i in sums else None
        if r == 1:
            e = F.col(p)
        elif r == 0:
            e = F.when(inside, 1.0 / F.col("__s")).otherwise(0.0)
        elif abs(r) == INF:
            e = F.when(inside & (ln == at), 1.0 / z).otherwise(0.0)
        else:
            e = F.when(inside, F.exp(r * (ln - at)) / z).otherwise(0.0)
        df = df.withColumn(f"{prefix}{i}", e)
    return df.drop("__hi", "__lo", "__s", *[f"__z{i}" for i in sums])


def conditional_logprobs(trajectories: DataFrame, arms: DataFrame, logprobs: str = "logprobs") -> DataFrame:
    """Add conditional: arm name -> sum of the log-probabilities after that arm's prefill; shorter texts have 0.

    arms (arm, prefill_tokens) is a configuration, a row an arm; it travels as one row with a map.
    """
    lengths = arms.agg(F.map_from_entries(F.collect_list(F.struct("arm", "prefill_tokens"))).alias("__lengths"))
    total = lambda n: F.aggregate(F.slice(F.col(logprobs), n + 1, F.greatest(F.size(logprobs), F.lit(1))), F.lit(0.0), lambda s, x: s + x)
    rows = trajectories.crossJoin(F.broadcast(lengths))  # one row
    return rows.withColumn("conditional", F.transform_values("__lengths", lambda _, n: total(n))).drop("__lengths")


def logprobs_for_condition(rows: DataFrame, condition: str, exclude_mismatch: bool = True) -> DataFrame:
    """(traj_idx, logprob) under a condition. A 0 marks rows outside it: they go, but for trunk or rows of that arm."""
    lp = F.coalesce(F.col("conditional")[condition], F.lit(0.0))
    out = rows.withColumn("logprob", lp)
    if exclude_mismatch and condition != "trunk":
        out = out.where((F.col("logprob") != 0) | F.col("arm").eqNullSafe(F.lit(condition)))
    return out.select("traj_idx", "logprob")


def suffix_representatives(trajectories: DataFrame, parents: DataFrame) -> DataFrame:
    """(arm, traj_idx, prob): of each arm's first trajectory the probability of the arm's own text given its parent's.

    trajectories (traj_idx, arm, logprobs, arm_end); parents (arm, parent_end). No parent, no log-probabilities or
    nothing between the two ends gives 1.
    """
    first = trajectories.groupBy("arm").agg(F.min_by(F.struct("traj_idx", "logprobs", "arm_end"), "traj_idx").alias("t"))
    rows = first.join(parents, "arm", "left").select("arm", "t.*", F.coalesce("parent_end", "t.arm_end").alias("parent_end"))
    return rows.select("arm", "traj_idx", suffix_prob(rows, "logprobs", "parent_end", "arm_end").alias("prob"))


def arm_statistics(systems: DataFrame) -> DataFrame:
    """Per arm: rows, probability mass, coverage in percent, largest logprob, mean perplexity."""
    p = F.when(F.col("logprob") > LEAST_LOGPROB, F.exp("logprob")).otherwise(0.0)
    ppl = F.exp(-F.col("logprob") / F.when(F.col("n_tokens") > 0, F.col("n_tokens")))
    return systems.groupBy("arm").agg(F.count("*").alias("n"), F.sum(p).alias("mass"), (100 * F.sum(p)).alias("coverage"), F.max("logprob").alias("best_logprob"), F.avg(ppl).alias("mean_ppl"))


def arm_rows(systems: DataFrame) -> DataFrame:
    """(traj_idx, arm, logprob, p, p_norm, ppl, inv_ppl_share): the rows behind arm_statistics(); ranking.py ranks them.

    p is 0 for a logprob up to LEAST_LOGPROB; p_norm is the row's share in its arm. Rows without tokens, or with p 0, have no perplexity and no share of its inverse; null
    logprobs count as 0.
    """
    lp, n = F.coalesce("logprob", F.lit(0.0)), F.coalesce("n_tokens", F.lit(0))
    given = systems.select("traj_idx", "arm", lp.alias("logprob"), n.alias("n_tokens"))
    rows = with_weights(given, ["prob"])
    inverse = _inv_ppl(F.col("logprob"), F.col("n_tokens"))
    rows = join_groups(rows, given.groupBy("arm").agg(F.sum(inverse).alias("__total")), ["arm"])
    known = (F.col("n_tokens") > 0) & (F.col("logprob") > LEAST_LOGPROB)
    return rows.select(
        "traj_idx",
        "arm",
        "logprob",
        F.when(F.col("logprob") > LEAST_LOGPROB, F.exp("logprob")).otherwise(0.0).alias("p"),
        F.col("w0").alias("p_norm"),
        F.when(known, F.exp(-F.col("logprob") / F.when(known, F.col("n_tokens")))).alias("ppl"),
        F.when(known, F.when(F.col("__total") > 0, inverse / F.when(F.col("__total") > 0, F.col("__total"))).otherwise(0.0)).alias("inv_ppl_share"),
    )


def arm_p0(rows: DataFrame) -> DataFrame:
    """(arm, p0): how likely an arm's prefill is by its first row: exp(logprob under trunk - logprob under the arm).

    rows: conditional_logprobs(). Root and trunk have none, nor has an arm with either at 0 (not conditioned on it).
    """
    first = rows.groupBy("arm").agg(F.min_by("conditional", "traj_idx").alias("c"))
    trunk, own = F.coalesce(F.col("c")["trunk"], F.lit(0.0)), F.coalesce(F.col("c")[F.col("arm")], F.lit(0.0))
    return first.where(~F.col("arm").isin("root", "trunk") & (trunk != 0) & (own != 0)).select("arm", F.exp(trunk - own).alias("p0"))


def suffix_prob(df: DataFrame, logprobs: str, start: str, end: str) -> Column:
    """exp of the logprobs in [start, end); none or an empty range gives 1."""
    part = F.slice(F.col(logprobs), F.col(start) + 1, F.greatest(F.col(end) - F.col(start), F.lit(0)))
    return F.coalesce(F.exp(F.aggregate(part, F.lit(0.0), lambda s, x: s + x)), F.lit(1.0))


def sibling_share(df: DataFrame, value: str, parent: str = "parent") -> DataFrame:
    """Add share (of the siblings' sum) and scale (min-max; an only child has 1)."""
    stats = df.groupBy(parent).agg(F.sum(value).alias("__s"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    v, s, lo, hi = F.col(value), F.col("__s"), F.col("__lo"), F.col("__hi")
    out = join_groups(df, stats, [parent])
    return out.withColumn("share", F.when(s == 0, 1.0).otherwise(v / F.when(s != 0, s))).withColumn("scale", F.when(hi == lo, 1.0).otherwise((v - lo) / F.when(hi != lo, hi - lo))).drop("__s", "__lo", "__hi")
