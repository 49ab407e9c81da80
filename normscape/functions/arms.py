"""Arm names (root, trunk, branch_N, twig_bN_M) as column expressions, and the arm dimension as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BRANCH, _TWIG = r"^branch_(\d+)$", r"^twig_b(\d+)_(\d+)$"


def _number(arm: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(arm, pattern, group).try_cast("int")


def arm_kind(arm: Column) -> Column:
    """root, trunk, twig or branch; unknown names are branches."""
    return F.when(arm.isin("root", "trunk"), arm).when(arm.startswith("twig_"), "twig").otherwise("branch")


def branch_no(arm: Column) -> Column:
    """N of branch_N or twig_bN_M; null where the name is malformed."""
    return F.coalesce(_number(arm, _BRANCH, 1), _number(arm, _TWIG, 1))


def twig_no(arm: Column) -> Column:
    return _number(arm, _TWIG, 2)


def parent_branch(arm: Column) -> Column:
    """branch_N of twig_bN_M; null for all others."""
    return F.when(twig_no(arm).isNotNull(), F.concat(F.lit("branch_"), _number(arm, _TWIG, 1)))


def parent_arm(arm: Column) -> Column:
    kind = arm_kind(arm)
    return F.when(kind == "trunk", "root").when(kind == "branch", "trunk").when(kind == "twig", parent_branch(arm))


def is_baseline(arm: Column) -> Column:
    return arm.isin("root", "trunk")


def is_reference(arm: Column) -> Column:
    return arm == "trunk"


def is_twig(arm: Column) -> Column:
    return arm_kind(arm) == "twig"


def sort_key(arm: Column) -> list[Column]:
    """root, trunk, then each branch followed by its twigs; names without a number sort with branch 0."""
    kind = arm_kind(arm)
    rank = F.when(kind == "root", 0).when(kind == "trunk", 1).otherwise(2)
    return [rank, F.coalesce(branch_no(arm), F.lit(0)), F.coalesce(twig_no(arm), F.lit(0)), arm]


def ancestry(arm: Column) -> Column:
    """The arms from root down to the arm itself."""
    kind, root, trunk = arm_kind(arm), F.lit("root"), F.lit("trunk")
    full = F.when(kind == "root", F.array(arm)).when(kind == "trunk", F.array(root, arm))
    return full.when(kind == "twig", F.array(root, trunk, parent_branch(arm), arm)).otherwise(F.array(root, trunk, arm))


def arm_name(i: Column) -> Column:
    return F.when(i == 0, "root").when(i == 1, "trunk").otherwise(F.concat(F.lit("branch_"), (i - 1).cast("string")))


def arm_closure(arms: DataFrame) -> DataFrame:
    """(arm, ancestor, depth): an arm's ancestors with itself, depth from the root."""
    return arms.select("arm", F.posexplode(ancestry(F.col("arm"))).alias("depth", "ancestor"))


def has_downstream(arms: DataFrame) -> DataFrame:
    """The arms that have others below them."""
    return arms.join(downstream(arms).select(F.col("reference").alias("arm")).distinct(), "arm", "left_semi")


def downstream(arms: DataFrame) -> DataFrame:
    """(reference, arm): root -> all others, trunk -> branches and twigs, branch -> its twigs."""
    pairs = arm_closure(arms).where("arm <> ancestor").select(F.col("ancestor").alias("reference"), "arm")
    return pairs.join(arms.select(F.col("arm").alias("reference")).distinct(), "reference", "left_semi")


def sibling_groups(arms: DataFrame) -> DataFrame:
    named = arms.select("arm", parent_arm(F.col("arm")).alias("parent")).where("parent IS NOT NULL")
    return named.groupBy("parent").agg(F.sort_array(F.collect_set("arm")).alias("arms"))


def arm_edges(arms: DataFrame) -> DataFrame:
    """(parent, arm): with no trunk among the arms, branches hang on root."""
    have = arms.select(F.col("arm").alias("parent")).distinct()
    has_trunk = have.agg(F.max((F.col("parent") == "trunk").cast("int")).alias("t"))
    parent = F.when((parent_arm(F.col("arm")) == "trunk") & (F.col("t") == 0), "root").otherwise(parent_arm(F.col("arm")))
    named = arms.select("arm").distinct().join(F.broadcast(has_trunk)).select(parent.alias("parent"), "arm")  # t is one row
    return named.join(have, "parent")


def arm_tree(arms: DataFrame) -> DataFrame:
    """(parent, arm, n_traj, p_given_parent) of arms with counts and probabilities; the topmost arm has no parent.

    With no trunk among the arms, branches hang on root; twigs whose branch is missing are left out. A missing count or
    probability is an error, and so are arms without root and trunk.
    """
    given = F.when(F.col("n_traj").isNull() | F.col("p_given_parent").isNull(), F.raise_error(F.concat(F.lit("no count or probability for arm "), F.col("arm"))).cast("string")).otherwise(F.col("arm"))
    rows = arms.select(given.alias("arm"), "n_traj", "p_given_parent")
    top = arms.agg(F.max(F.when(F.col("arm") == "root", 2).when(F.col("arm") == "trunk", 1).otherwise(0)).alias("__t"))  # one row
    name = F.when(F.col("__t") == 2, "root").when(F.col("__t") == 1, "trunk").otherwise(F.raise_error(F.lit("neither root nor trunk among the arms")).cast("string"))
    first = rows.join(F.broadcast(top.select(name.alias("__top"))), F.col("arm") == F.col("__top")).select(F.lit(None).cast("string").alias("parent"), "arm", "n_traj", "p_given_parent")
    return first.unionByName(arm_edges(arms).join(rows, "arm").select("parent", "arm", "n_traj", "p_given_parent"))


def filter_arm(df: DataFrame, arm: str) -> DataFrame:
    """Rows of one arm; an unknown arm is an error that lists the arms (a dimension: a row an arm, the first 100 shown)."""
    names = df.select("arm").distinct()  # reads that one column
    known, some = names.agg(F.max(F.col("arm") == arm), F.slice(F.sort_array(F.collect_list("arm")), 1, 100)).first()
    if not known:
        raise ValueError(f"no arm {arm!r}; there are {some}")
    return df.where(F.col("arm") == arm)


def added_text(arms: DataFrame) -> DataFrame:
    """(arm, added): what an arm's prefill adds to its parent's; the arm's name if it does not extend it."""
    parents = arms.select(F.col("arm").alias("p"), F.col("prefill").alias("pp"))
    joined = arms.join(parents, parent_arm(F.col("arm")) == F.col("p"), "left")
    extends = F.col("prefill").startswith(F.coalesce("pp", F.lit("")))
    return joined.select("arm", F.when(extends, F.expr("substring(prefill, length(coalesce(pp, '')) + 1)")).otherwise(F.col("arm")).alias("added"))


def expand_arms(spark: SparkSession, prompt: str, trunk: str = "", branches: list[str] = (), twigs: list[str] = ()) -> DataFrame:
    """(arm, prefill, parent) of a prompt's tree: every twig repeats under every branch."""
    rows = [("root", "", None)] + ([("trunk", trunk, "root")] if trunk else [])
    base = spark.createDataFrame(rows, "arm string, prefill string, parent string").withColumn("prompt", F.lit(prompt))
    b = spark.createDataFrame([(i + 1, t) for i, t in enumerate(branches)], "b int, bt string")
    up = "trunk" if trunk else "root"
    branch = b.select(F.concat(F.lit("branch_"), "b").alias("arm"), F.concat(F.lit(trunk), "bt").alias("prefill"), F.lit(up).alias("parent"), F.lit(prompt).alias("prompt"))
    twig = b.select("b", "bt", F.posexplode(F.array(*map(F.lit, twigs)).cast("array<string>")).alias("t", "tt")).select(F.concat(F.lit("twig_b"), "b", F.lit("_"), F.col("t") + 1).alias("arm"), F.concat(F.lit(trunk), "bt", "tt").alias("prefill"), F.concat(F.lit("branch_"), "b").alias("parent"), F.lit(prompt).alias("prompt"))
    return base.unionByName(branch).unionByName(twig)


def expand_template(spark: SparkSession, template: str, words: list[str]) -> DataFrame:
    """One arm a word, its prompt the template with {word} filled in; both are needed."""
    if not template or not words:
        raise ValueError("a template needs words, and words a template")
    return spark.createDataFrame([(w,) for w in words], "arm string").withColumn("prompt", F.replace(F.lit(template), F.lit("{word}"), F.col("arm")))
