"""Deviance and orientation: cores joined back to rows, and the full estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normscape.functions import arms as A
from normscape.functions import vectors as V
from normscape.operators.weights import RAW, join_groups
from normscape.sources.shared import settled, small


def with_core(systems: DataFrame, cores: DataFrame) -> DataFrame:
    """Each row with its arm's core (arm, core), a row an arm; give cores that are settled() if they are used again."""
    return join_groups(systems, cores.select("arm", "core"), ["arm"])


def _structures(cores: DataFrame, name: str = "core") -> int | None:
    """How many structures all cores have, if that is one number: sums over so few are written out, which compiles."""
    low, high = cores.agg(F.min(F.size(name)), F.max(F.size(name))).first()  # of a row an arm
    return low if low == high and low is not None and 0 < low <= 64 else None


def trajectory_deviance(systems: DataFrame, cores: DataFrame, kind: str = "l2") -> DataFrame:
    """Add orientation (array) and deviance of each row to its arm's core."""
    both = with_core(systems, cores)
    return both.withColumn("orientation", V.orientation(F.col("system"), F.col("core"))).withColumn("deviance", V.deviance(F.col("system"), F.col("core"), kind))


def expected(df: DataFrame, value: str, weight: str = "w", keys: tuple = ("arm",)) -> DataFrame:
    """(keys.., mean, variance) of a column under the weights; the variance is clamped at 0."""
    s, v = F.sum(weight), F.col(value)
    mean = F.when(s < V.EPS, F.avg(v)).otherwise(F.sum(F.col(weight) * v) / s)
    square = F.when(s < V.EPS, F.avg(v * v)).otherwise(F.sum(F.col(weight) * v * v) / s)
    return df.groupBy(*keys).agg(mean.alias("mean"), F.greatest(square - mean * mean, F.lit(0.0)).alias("variance"))


def expected_orientation(systems: DataFrame, cores: DataFrame, weight: str = "w") -> DataFrame:
    rows = trajectory_deviance(systems, cores).select("arm", weight, F.posexplode("orientation").alias("struct_idx", "o"))
    return rows.groupBy("arm", "struct_idx").agg((F.sum(F.col(weight) * F.col("o")) / F.sum(weight)).alias("value"))


def _divergences(rows: DataFrame, weight: str, n: int) -> DataFrame:
    """(arm, weight, x, d, m) of order 1 between system and core of n structures each, as sums written out."""
    same = F.when((F.size("system") == n) & (F.size("core") == n), F.col("system")).otherwise(F.raise_error(F.lit("lengths differ")).cast("array<double>"))
    rows = rows.withColumn("__x", same)
    for name, own in (("s", "__x"), ("t", "core")):
        rows = rows.withColumn(f"__{name}", sum((F.get(own, F.lit(i)) for i in range(n)), F.lit(0.0)))
    share = lambda own, total, i: F.when(F.col(total) < V.EPS, 1.0 / n).otherwise(F.get(own, F.lit(i)) / F.col(total))
    rows = rows.select("arm", weight, *[share("__x", "__s", i).alias(f"__p{i}") for i in range(n)], *[share("core", "__t", i).alias(f"__q{i}") for i in range(n)])
    p, q = [F.col(f"__p{i}") for i in range(n)], [F.col(f"__q{i}") for i in range(n)]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda xs, ys: sum((F.when(x <= V.EPS, 0.0).when(y < V.EPS, V.INF).otherwise(x * F.ln(x / y)) for x, y in zip(xs, ys)), F.lit(0.0))
    return rows.select("arm", weight, F.exp(kl(p, q)).alias("x"), F.exp(kl(q, p)).alias("d"), F.exp((kl(p, m) + kl(q, m)) / 2).alias("m"))


def expected_divergences(systems: DataFrame, cores: DataFrame, weight: str = "w", alpha: float = 1.0) -> DataFrame:
    """(arm, excess, deficit, mutual, n_infinite): weighted means; 0 * infinity stays NaN, n_infinite tells."""
    cores = settled(cores.select("arm", "core"))
    n = _structures(cores)
    rows = with_core(systems, cores)
    if n is not None and alpha == 1.0:
        rows = _divergences(rows, weight, n)
    else:
        p, q = F.col("__p"), F.col("__q")
        rows = rows.select("arm", weight, V.shares(F.col("system")).alias("__p"), V.shares(F.col("core")).alias("__q"))
        rows = rows.select("arm", weight, F.exp(V.renyi_divergence(p, q, alpha)).alias("x"), F.exp(V.renyi_divergence(q, p, alpha)).alias("d"), F.exp(V.js(p, q)).alias("m"))
    mean = lambda n: F.sum(F.col(weight) * F.col(n)) / F.sum(weight)
    infinite = F.sum(((F.col("x") == V.INF) | (F.col("d") == V.INF)).cast("long"))
    return rows.groupBy("arm").agg(mean("x").alias("excess"), mean("d").alias("deficit"), mean("m").alias("mutual"), infinite.alias("n_infinite"))


def orientation_from(cores: DataFrame, reference: str) -> DataFrame:
    """(arm, orientation, norm) of each core from its reference arm's (root, trunk or parent); none: empty and 0."""
    ref = A.parent_arm(F.col("arm")) if reference == "parent" else F.lit(reference)
    other = cores.select(F.col("arm").alias("__ref"), F.col("core").alias("__core"))
    joined = cores.withColumn("__want", ref).join(other, F.col("__want") == F.col("__ref"), "left")
    o = F.when(F.col("__core").isNull(), F.array().cast("array<double>")).otherwise(V.orientation(F.col("core"), F.col("__core")))
    return joined.select("arm", o.alias("orientation"), V.norm(o).alias("norm"))


def deviance_to(systems: DataFrame, cores: DataFrame, reference: str, weight: str = "w") -> DataFrame:
    """(arm, mean, variance): weighted deviance of each arm's rows to the reference arm's core; no such core: 0."""
    one = cores.where(F.col("arm") == reference).select(F.col("core").alias("__c"))
    joined = systems.join(F.broadcast(one.limit(1)), F.lit(True), "left")
    d = F.when(F.col("__c").isNull(), 0.0).otherwise(V.deviance(F.col("system"), F.col("__c")))
    return expected(joined.withColumn("__d", d), "__d", weight)


def relative_orientations(cores: DataFrame) -> DataFrame:
    """(node, other, orientation) for all ordered pairs of the few node cores."""
    a, b = cores.select(F.col("arm").alias("node"), F.col("core").alias("x")), cores.select(F.col("arm").alias("other"), F.col("core").alias("y"))
    return a.join(small(b), F.col("node") != F.col("other")).select("node", "other", V.orientation(F.col("x"), F.col("y")).alias("orientation"))


def orientation_std(samples: DataFrame, keys: tuple = ("node",)) -> DataFrame:
    """(keys.., struct_idx, value): deviation of the samples' orientations, which is that of the samples themselves."""
    rows = samples.select(*keys, F.posexplode("system").alias("struct_idx", "x"))
    return rows.groupBy(*keys, "struct_idx").agg(F.stddev_pop("x").alias("value"))


def qr_profile(estimates: DataFrame) -> DataFrame:
    """(axis, arm, order, mean) of estimates (arm, q, r, mean): along q where r is 1, and along r where q is 1.

    To be read in order of axis, arm and order; -infinity sorts first and infinity last.
    """
    along = lambda axis, other: estimates.where(F.col(other) == 1).select(F.lit(axis).alias("axis"), "arm", F.col(axis).alias("order"), "mean")
    return along("q", "r").unionByName(along("r", "q"))


def compare_methods(estimates: DataFrame, runs: list[str], values: tuple = ("n", "expected_deviance")) -> DataFrame:
    """(arm, method, a column a run and value): estimates (arm, method, run, values..) of generation runs side by side."""
    cells = [F.max(F.when(F.col("run") == r, F.col(v))).alias(f"{r}_{v}") for r in runs for v in values]
    return estimates.groupBy("arm", "method").agg(*cells)


def downstream_orientation(cores: DataFrame) -> DataFrame:
    """(reference, arm, norm) for every reference arm and the arms below it."""
    pairs = A.downstream(cores.select("arm"))
    x = cores.select("arm", F.col("core").alias("x"))
    y = cores.select(F.col("arm").alias("reference"), F.col("core").alias("y"))
    return pairs.join(x, "arm").join(y, "reference").select("reference", "arm", V.norm(V.orientation(F.col("x"), F.col("y"))).alias("norm"))


def estimate(systems: DataFrame, methods: tuple = ("inv-ppl", "prob", "uniform"), include_greedy: bool = False) -> DataFrame:
    """(arm, method, n, expected_deviance, deviance_variance, deviance_root, deviance_trunk, diversity, norm_parent).

    Weighted standard core per arm and method, the deviance under the same weights, and the distance to reference
    cores. The rows are read three times: for the largest log-probability, the cores and the deviances, of which the
    first two leave a row an arm. Rows flagged greedy stay out of the weights unless asked for.
    """
    rows = systems if include_greedy or "is_greedy" not in systems.columns else systems.where("NOT coalesce(is_greedy, false)")
    numbers = range(len(methods))
    lp, n_tokens = F.coalesce("logprob", F.lit(0.0)), F.coalesce("n_tokens", F.lit(0))
    top = settled(rows.groupBy("arm").agg(F.max(lp).alias("__top")))
    raws = [RAW[m](lp, n_tokens, F.col("__top")).alias(f"u{i}") for i, m in enumerate(methods)]
    raw = join_groups(rows, top, ["arm"]).select("arm", "system", *raws)
    cells = raw.select("arm", *[f"u{i}" for i in numbers], F.posexplode("system").alias("struct_idx", "x"))
    sums = [a for i in numbers for a in (F.sum(f"u{i}").alias(f"s{i}"), F.sum(F.col(f"u{i}") * F.col("x")).alias(f"v{i}"))]
    cells = cells.groupBy("arm", "struct_idx").agg(*sums, F.avg("x").alias("m"))
    usable = [(F.col(f"s{i}") != 0) & ~F.isnan(f"s{i}") & (F.abs(f"s{i}") != V.INF) for i in numbers]
    means = [F.when(ok, F.col(f"v{i}") / F.when(ok, F.col(f"s{i}"))).otherwise(F.col("m")).alias(f"v{i}") for i, ok in enumerate(usable)]
    cells = cells.select("arm", "struct_idx", *means, *[ok.alias(f"ok{i}") for i, ok in enumerate(usable)])
    pairs = F.array_sort(F.collect_list(F.struct("struct_idx", *[f"v{i}" for i in numbers])))  # an entry a structure
    oks = [F.first(f"ok{i}").alias(f"ok{i}") for i in numbers]
    cores = settled(cells.groupBy("arm").agg(pairs.alias("s"), *oks).select("arm", *[F.col(f"s.v{i}").alias(f"c{i}") for i in numbers], *[f"ok{i}" for i in numbers]))
    n = _structures(cores, "c0")
    joined = join_groups(raw, cores, ["arm"])
    for i in numbers:  # no usable sum of weights: equal ones
        joined = joined.withColumn(f"w{i}", F.when(F.col(f"ok{i}"), F.col(f"u{i}")).otherwise(1.0))
    for ref in ("root", "trunk"):
        one = cores.where(F.col("arm") == ref).select(*[F.col(f"c{i}").alias(f"{ref}{i}") for i in numbers])
        joined = joined.join(F.broadcast(one), F.lit(True), "left")  # one row at most
    sums = [F.count("*").alias("n")]
    for i in numbers:
        w, x = F.col(f"w{i}"), F.col("system")
        total, d = F.sum(w), V.deviance(x, F.col(f"c{i}"), structures=n)
        sums += [(F.sum(w * d) / total).alias(f"e{i}"), (F.sum(w * d * d) / total).alias(f"q{i}")]
        for ref in ("root", "trunk"):
            far = F.when(F.col(f"{ref}{i}").isNull(), 0.0).otherwise(V.deviance(x, F.col(f"{ref}{i}"), structures=n))
            sums.append((F.sum(w * far) / total).alias(f"{ref}_{i}"))
    parents = cores.select(F.col("arm").alias("__arm"), *[F.col(f"c{i}").alias(f"p{i}") for i in numbers])
    out = joined.groupBy("arm").agg(*sums).join(cores, "arm").join(parents, A.parent_arm(F.col("arm")) == F.col("__arm"), "left")
    cells = []
    for i, m in enumerate(methods):
        norm = F.when(F.col(f"p{i}").isNull(), 0.0).otherwise(V.norm(V.orientation(F.col(f"c{i}"), F.col(f"p{i}"))))
        e = F.col(f"e{i}")
        cells.append(F.struct(F.lit(m).alias("method"), F.col("n"), e.alias("expected_deviance"), F.greatest(F.col(f"q{i}") - e * e, F.lit(0.0)).alias("deviance_variance"), F.col(f"root_{i}").alias("deviance_root"), F.col(f"trunk_{i}").alias("deviance_trunk"), V.diversity(F.col(f"c{i}")).alias("diversity"), norm.alias("norm_parent")))
    return out.select("arm", F.inline(F.array(*cells)))
