"""Findings of round 3: larger keys, far modes, common groups and long texts."""

from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from normscape.functions import text as T
from normscape.operators import cores as C
from normscape.operators import prefixes as P
from normscape.operators import ranking as RK
from normscape.operators import scoring as S
from normscape.operators import trees as K
from normscape.operators import weights as W
from normscape.plans import catalog
from normscape.sources.shared import settled
from tests.compare import TABLES, same

SF = "/root/testdata/sf0.001"


def _with(tmp_path, name, sql):
    """The small tables, one of them replaced by a query."""
    for t in TABLES:
        if t != name:
            Path(tmp_path, f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_halves_of_lines_with_large_part_keys(spark, tmp_path):
    d = _with(tmp_path, "lineitem", f"SELECT * REPLACE (l_partkey + 1000003 * (l_orderkey % 2) AS l_partkey, l_suppkey + 10007 AS l_suppkey) FROM '{SF}/lineitem.parquet'")
    same(spark, catalog.QUERIES["H20_compare_methods"], catalog.ORACLES["H20_compare_methods"], d)


def test_mode_of_densities_below_nine_decimals(spark):
    # zeros and ones: both peaks lie eight kernels off the grid's ends, the higher one at the upper end
    rows = spark.range(1_500_000).select(F.lit("trunk").alias("arm"), F.array((F.col("id") % 3 != 0).cast("double"), (F.col("id") % 20 != 0).cast("double") + 1.0, F.when(F.col("id") == 0, 0.0).otherwise(-1.0)).alias("system"))
    got = {r["struct_idx"]: r["value"] for r in C.mode_core(rows).collect()}
    assert all(abs(got[i] - v) < 1e-9 for i, v in enumerate((1 / 1002, 1.95, -1 + 1 / 1_500_000)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_stay_where_they_are_for_values_of_their_group(spark, tmp_path):
    spark.range(100).selectExpr("id AS traj_idx", "IF(id % 3 = 0, NULL, 'trunk') AS arm", "-id / 10D AS logprob", "1 AS n_tokens", "id + 0D AS v").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    for df in (W.with_weight(t, "prob"), W.normalize(t, "v", ("arm",)), W.escort(W.with_weight(t), [2, -1]), W.arm_rows(t)):
        assert "SortMergeJoin" not in _plan(df) and "hashpartitioning" not in _plan(df)
        assert df.count() == 100


def test_medians_of_groups_with_nulls_alone(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), ("b", None), (None, 3.0)], "g string, x double")
    assert {r["g"]: r["median"] for r in RK.medians(t, ["g"], "x").collect()} == {"a": 2.5, "b": None, None: 3.0}


def test_walk_joins_no_arm_in_one_task(spark, monkeypatch):
    plans, settle = [], C.settled
    monkeypatch.setattr(C, "settled", lambda df: plans.append(_plan(df)) or settle(df))
    rows = [(i, "trunk", ["a", "b" if i % 3 else "c", str(i % 5), "z"][: 2 + i % 3]) for i in range(60)]
    got = C.majority_walk(spark.createDataFrame(rows, "traj_idx long, arm string, tokens array<string>")).collect()
    assert not any("SortMergeJoin" in p for p in plans) and len(plans) > 3
    assert [tuple(r) for r in got] == [("trunk", 5)]


def test_forks_of_a_node_with_many_branches(spark, monkeypatch):
    monkeypatch.setattr(K, "_LISTED", 3)
    monkeypatch.setattr(K, "_PAIRS", 20)
    texts = [(i, "ab"[i % 2], f"w{i % 23} {'xyz'[i % 3]} {i % 7}".split()) for i in range(90)]
    seqs = spark.createDataFrame(texts, "traj_idx long, arm string, tokens array<string>")
    pairs = spark.createDataFrame([("a", "b")], "arm_a string, arm_b string")
    lists = K._fork_lists(seqs, pairs)
    assert lists.select(F.max(F.size("tokens_a") * F.size("tokens_b"))).first()[0] < 23 * 23 / 4
    assert len([n for n in lists.rdd.glom().map(len).collect() if n]) > 4  # one node, many tasks
    branches = {}
    for _, arm, t in texts:
        for k in range(3):
            branches.setdefault((k, tuple(t[:k])), {}).setdefault(arm, set()).add(t[k])
    want = {}
    for (k, _), arms in branches.items():
        for x in arms.get("a", ()):
            for y in arms.get("b", ()):
                if x != y:
                    want[k, "a", "b", x, y] = want.get((k, "a", "b", x, y), 0) + 1
    rows = K.fork_counts(seqs, pairs).collect()
    assert {tuple(r)[:5]: r["n"] for r in rows} == want and len(rows) == len(want)
    assert K.forks_between(seqs, pairs).count() == sum(want.values())


def test_prefixes_of_a_long_text(spark):
    text = "ab " * 40_000  # characters times words are beyond 2 ** 31
    df = spark.createDataFrame([(text, 40_000)], "text string, n_tokens int")
    rows = T.prefixes_at_steps(df, step=15_000).select("k", F.char_length("prefix").alias("n")).collect()
    assert sorted(tuple(r) for r in rows) == [(15_000, 45_000), (30_000, 90_000), (40_000, 120_000)]


def test_sums_down_a_word_tree_without_its_words_as_rows(spark, monkeypatch):
    texts = ["a b c d", "a b c e f", "a b", "a b c d", "x", "x y z", "a b c d q r", "a b c e f g h"] + [f"a b c e f g {i % 5} {i}" for i in range(30)]
    seqs = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "traj_idx long, tokens array<string>").repartition(3)
    value = lambda w: F.char_length(w) * F.lit(-0.5) - F.ascii(w) * F.lit(0.25)
    tree = K.word_tree(seqs).withColumn("logprob", value(F.col("word")))
    want = tree.select("node", "depth").join(K.propagate_logprob(tree), "node").collect()
    written, settle = [], K.settled
    monkeypatch.setattr(K, "settled", lambda df: written.append(df.count()) or settle(df))
    got = K.word_tree_sums(seqs, value).collect()
    at = lambda rows, c: sorted((r["depth"], round(r[c], 9)) for r in rows)
    assert at(got, "total") == at(want, "logprob") and len(got) > max(written)
    assert len({r["node"] for r in got}) == len(got)


def test_common_words_meet_a_lexicon_that_is_broadcast(spark):
    texts = spark.createDataFrame([(i, "good bad good plain") for i in range(20)], "traj_idx long, text string")
    lexicon = settled(spark.createDataFrame([("good", 2.0), ("bad", -1.0), ("plain", 0.0)], "word string, z double"))
    df = S.top_words_by_text(texts, lexicon)
    assert "SortMergeJoin" not in _plan(df)
    assert df.count() == 60


def test_partitions_of_a_prefix_tree_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "_ROWS", 20)
    rows = [(i, f"a {i % 7} {i}".split()) for i in range(200)]
    walked = P._sorted(spark.createDataFrame(rows, "traj_idx long, tokens array<string>"), ["traj_idx"], False)
    sizes = [r["count"] for r in walked.groupBy("part").count().collect()]
    assert len(sizes) > 6 and max(sizes) < 60
