"""Numeric column expressions: array distances, divergences, entropies, aggregates that keep IEEE results."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
INF = float("inf")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def safe_ln(x: Column) -> Column:
    return F.when(x > EPS, F.ln(x)).otherwise(F.lit(-INF))


def orientation(system: Column, core: Column) -> Column:
    """system - core; different lengths are an error."""
    same = F.when(F.size(system) != F.size(core), F.raise_error(F.lit("lengths differ")).cast("array<double>"))
    return same.otherwise(F.zip_with(system, core, lambda x, y: x - y))


def norm(v: Column, kind: str = "l2") -> Column:
    if kind == "l2":
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    if kind == "l1":
        return total(F.transform(v, F.abs))
    return F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0))


def normalized_norm(v: Column, kind: str = "l2") -> Column:
    n = F.greatest(F.size(v), F.lit(1))
    return norm(v, kind) / {"l2": F.sqrt(n), "l1": n.cast("double"), "linf": F.lit(1.0)}[kind]


def deviance(system: Column, core: Column, kind: str = "l2", structures: int | None = None) -> Column:
    """The norm of system - core. structures: how many most systems have, if known: their l2 norm is written out."""
    folded = norm(orientation(system, core), kind)
    if structures is None or kind != "l2":
        return folded
    squares = [(F.get(system, F.lit(i)) - F.get(core, F.lit(i))) for i in range(structures)]
    return F.when((F.size(system) == structures) & (F.size(core) == structures), F.sqrt(sum(x * x for x in squares))).otherwise(folded)


def normalized_deviance(system: Column, core: Column, kind: str = "l2") -> Column:
    return normalized_norm(orientation(system, core), kind)


def shares(v: Column) -> Column:
    """v / sum; below EPS in all: uniform."""
    return let(total(v), lambda s: F.when(s < EPS, F.transform(v, lambda x: F.lit(1.0) / F.size(v))).otherwise(F.transform(v, lambda x: x / s)))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > EPS, x * F.ln(x)).otherwise(0.0)))


def diversity(v: Column) -> Column:
    return F.exp(entropy(shares(v)))


def effective_structures(v: Column) -> Column:
    a = F.transform(v, F.abs)
    return F.when(total(a) < 1e-10, F.size(v).cast("double")).otherwise(diversity(a))


def kl(p: Column, q: Column) -> Column:
    terms = F.zip_with(p, q, lambda x, y: F.when(x <= EPS, 0.0).when(y < EPS, INF).otherwise(x * F.ln(x / y)))
    return total(terms)


def renyi_divergence(p: Column, q: Column, alpha: float) -> Column:
    """Of two distributions that are normalised already."""
    if alpha == 1:
        return kl(p, q)
    if alpha == 0:
        s = total(F.zip_with(p, q, lambda x, y: F.when(x > EPS, y).otherwise(0.0)))
        return F.when(s < EPS, INF).otherwise(-F.ln(s))
    if alpha == INF:
        return F.array_max(F.zip_with(p, q, lambda x, y: F.when(x <= EPS, -INF).when(y < EPS, INF).otherwise(F.ln(x / y))))
    s = total(F.zip_with(p, q, lambda x, y: F.when(x <= EPS, 0.0).when(y < EPS, INF if alpha > 1 else 0.0).otherwise(F.pow(x, F.lit(alpha)) * F.pow(y, F.lit(1 - alpha)))))
    return F.when(s < EPS, INF).otherwise(F.ln(s) / (alpha - 1))


def js(p: Column, q: Column) -> Column:
    return let(F.zip_with(p, q, lambda x, y: (x + y) / 2), lambda m: (kl(p, m) + kl(q, m)) / 2)


def excess_deviance(system: Column, core: Column, alpha: float = 1.0) -> Column:
    return F.exp(renyi_divergence(shares(system), shares(core), alpha))


def deficit_deviance(system: Column, core: Column, alpha: float = 1.0) -> Column:
    return F.exp(renyi_divergence(shares(core), shares(system), alpha))


def mutual_deviance(system: Column, core: Column) -> Column:
    return F.exp(js(shares(system), shares(core)))


def power_mean(xs: Column, a: float) -> Column:
    """Power mean of an array; for a <= 0 entries up to EPS leave the sum but not the count."""
    n = F.size(xs)
    kept = F.filter(xs, lambda x: x > EPS) if a <= 0 else xs
    if abs(a) == INF:
        out = F.array_max(xs) if a > 0 else F.array_min(xs)
    elif a == 0:
        out = F.exp(total(F.transform(kept, F.ln)) / n)
    else:
        s = total(F.transform(kept, lambda x: F.pow(x, F.lit(float(a))))) / n
        out = F.when(s > 0, F.pow(s, F.lit(1.0 / a))).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(out)


def weighted_power_mean(x: Column, w: Column, a: float) -> Column:
    """Aggregate: weights up to EPS, and for a <= 0 values up to EPS, are left out, the rest renormalised."""
    keep = (w > EPS) & (x > EPS) if a <= 0 else w > EPS
    s = F.sum(F.when(keep, w))
    if a == INF:
        out = F.max(F.when(keep, x))
    elif a == -INF:
        out = F.min(F.when(keep, x))
    elif a == 0:
        out = F.exp(F.sum(F.when(keep, w * F.ln(F.when(x > EPS, x)))) / s)
    else:
        m = F.sum(F.when(keep, w * F.pow(x, F.lit(float(a))))) / s
        out = F.when(m > 0, F.pow(m, F.lit(1.0 / a))).otherwise(0.0)
    return F.coalesce(F.when(s > EPS, out), F.lit(0.0))


def renyi_entropy(p: Column, q: float) -> Column:
    """Aggregate over the probabilities of a group; nothing above EPS gives infinity."""
    some, keep = F.count(F.when(p > EPS, 1)), F.when(p > EPS, p)
    if q == 0:
        out = F.ln(some)
    elif q == 1:
        out = -F.sum(keep * F.ln(keep))
    elif q == INF:
        out = -F.ln(F.max(keep))
    elif q == -INF:
        out = -F.ln(F.min(keep))
    else:
        out = F.ln(F.sum(F.pow(keep, F.lit(float(q))))) / (1 - q)
    return F.coalesce(out, F.lit(INF))


def hill_number(p: Column, q: float) -> Column:
    return F.when(F.count(F.when(p > EPS, 1)) == 0, 0.0).otherwise(F.exp(renyi_entropy(p, q)))


def concentration(d: Column) -> Column:
    return F.when(d <= EPS, INF).otherwise(1 / F.when(d > EPS, d))


def probs_to_logprobs(ps: Column) -> Column:
    """Logarithms of an array of probabilities; those up to EPS give -infinity."""
    return F.transform(ps, safe_ln)


def logprobs_to_probs(lp: Column) -> Column:
    return F.transform(lp, F.exp)


def empirical_cross_entropy(lp: Column) -> Column:
    """Mean negative log-probability; empty: infinity."""
    n = F.size(lp)
    return F.when(n == 0, INF).otherwise(-total(lp) / F.greatest(n, F.lit(1)))


def alpha_inv_perplexity(lp: Column, alpha: float) -> Column:
    """Power mean of order alpha of the probabilities: 0 is the usual inverse perplexity, -infinity the worst token's."""
    return power_mean(logprobs_to_probs(lp), alpha)


def alpha_perplexity(lp: Column, alpha: float) -> Column:
    """1 / alpha_inv_perplexity(); a mean up to EPS, or no token, gives infinity."""
    return let(alpha_inv_perplexity(lp, alpha), lambda m: F.when((F.size(lp) == 0) | m.isNull() | (m <= EPS), INF).otherwise(1 / m))


def perplexity(lp: Column) -> Column:
    """exp of the mean negative log-probability; empty: infinity."""
    n = F.size(lp)
    return F.when(n == 0, INF).otherwise(F.exp(-total(lp) / F.greatest(n, F.lit(1))))


def partial_logprob(lp: Column, start: Column, end: Column) -> Column:
    ok = (start >= 0) & (end > start) & (end <= F.size(lp))
    return F.when(ok, total(F.slice(lp, F.when(ok, start + 1).otherwise(1), F.when(ok, end - start).otherwise(0))))


def log_sum_exp(xs: Column) -> Column:
    """Of an array; empty or all -infinity gives -infinity."""
    top = F.array_max(xs)
    return F.when(F.size(xs) == 0, -INF).when(F.abs(top) == INF, top).otherwise(top + F.ln(total(F.transform(xs, lambda x: F.exp(x - top)))))


def surprise(lp: Column) -> Column:
    return -lp


def rarity(lp: Column) -> Column:
    return F.exp(-lp)


def worst_logprob(lp: Column) -> Column:
    return F.coalesce(F.array_min(lp), F.lit(0.0))


def best_logprob(lp: Column) -> Column:
    return F.coalesce(F.array_max(lp), F.lit(0.0))


def best_position(lp: Column) -> Column:
    return F.when(F.size(lp) > 0, F.array_position(lp, F.array_max(lp)) - 1).otherwise(0)


def worst_position(lp: Column) -> Column:
    return F.when(F.size(lp) > 0, F.array_position(lp, F.array_min(lp)) - 1).otherwise(0)


def fork_metrics(pa: Column, pb: Column) -> dict[str, Column]:
    s = pa + pb
    a = F.when(s < EPS, 0.5).otherwise(pa / F.when(s >= EPS, s))
    b = 1 - a
    h = -F.when(a > EPS, a * F.ln(a)).otherwise(0.0) - F.when(b > EPS, b * F.ln(b)).otherwise(0.0)
    return {
        "entropy": h, "diversity": F.exp(h), "concentration": F.exp(-h),
        "ratio": F.when(pb < EPS, INF).otherwise(pa / F.when(pb >= EPS, pb)),
        "log_odds": F.when(pb < EPS, INF).when(pa < EPS, -INF).otherwise(F.ln(F.when(pa >= EPS, pa) / F.when(pb >= EPS, pb))),
        "margin": pa - pb, "abs_margin": F.abs(pa - pb), "winner": F.when(pa >= pb, "A").otherwise("B"), "winning_prob": F.greatest(pa, pb),
    }


def faithfulness(clean: Column, corrupted: Column, patched: Column) -> dict[str, Column]:
    """Share of the clean-corrupted gap that a patch recovers or disrupts; a gap below 1e-10 gives 0.

    The four scores name what a share says by the kind of patch: clean values put into a corrupted run inside the circuit
    (sufficiency) or outside it (completeness), corrupted ones put into a clean run inside (necessity) or outside
    (independence).
    """
    gap = clean - corrupted
    share = lambda x: F.when(F.abs(gap) < 1e-10, 0.0).otherwise(x / F.when(F.abs(gap) >= 1e-10, gap))
    recovery, disruption = share(patched - corrupted), share(clean - patched)
    return {"recovery": recovery, "disruption": disruption, "sufficiency": recovery, "completeness": disruption, "necessity": disruption, "independence": recovery}


def sanitize(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).when(x == INF, 1000.0).when(x == -INF, -1000.0).otherwise(x)


def safe_float(x: Column, default: float | None = None) -> Column:
    """A number from text: Inf and NaN in their usual spellings; null and junk give the default."""
    t = F.lower(F.trim(x))
    out = F.when(t.isin("inf", "+inf", "infinity", "+infinity"), INF).when(t.isin("-inf", "-infinity"), -INF).when(t == "nan", math.nan)
    return F.coalesce(out.otherwise(t.try_cast("double")), F.lit(default))
