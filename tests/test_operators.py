import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from normscape.functions import arms as A
from normscape.functions import text as T
from normscape.functions import vectors as V
from normscape.operators import cores as C
from normscape.operators import deviance as D
from normscape.operators import dynamics as M
from normscape.operators import ensemble as E
from normscape.operators import registry as R
from normscape.operators import scoring as S
from normscape.operators import systems as Y
from normscape.operators import trees as K
from normscape.operators import weights as W
from normscape.sources import tables as IO

INF = float("inf")


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def systems(spark, rows):
    return spark.createDataFrame(rows, "traj_idx long, arm string, system array<double>, logprob double, n_tokens int, is_greedy boolean, tokens array<string>")


def seqs(spark, lists):
    return spark.createDataFrame([(i, "trunk" if i % 2 else "root", x) for i, x in enumerate(lists)], "traj_idx long, arm string, tokens array<string>")


def test_arms(spark):
    df = spark.createDataFrame([(a,) for a in ("root", "trunk", "branch_2", "branch_10", "twig_b2_1", "odd")], "arm string")
    assert [r[0] for r in df.orderBy(*A.sort_key(F.col("arm"))).collect()] == ["root", "trunk", "odd", "branch_2", "twig_b2_1", "branch_10"]
    assert {r["arm"]: r["k"] for r in df.select("arm", A.arm_kind(F.col("arm")).alias("k")).collect()}["odd"] == "branch"
    assert {(r["reference"], r["arm"]) for r in A.downstream(df).collect()} >= {("branch_2", "twig_b2_1"), ("root", "odd"), ("trunk", "twig_b2_1")}
    with pytest.raises(ValueError, match="branch_2"):
        A.filter_arm(df, "nope")
    tree = {r["arm"]: (r["prefill"], r["parent"]) for r in A.expand_arms(spark, "p", "T", ["a", "b"], ["x"]).collect()}
    assert tree["twig_b2_1"] == ("Tbx", "branch_2") and tree["branch_1"] == ("Ta", "trunk") and tree["root"] == ("", None)
    added = {r["arm"]: r["added"] for r in A.added_text(A.expand_arms(spark, "p", "T", ["a"], ["x"])).collect()}
    assert added["twig_b1_1"] == "x" and added["branch_1"] == "a"
    assert A.expand_template(spark, "a {word}!", ["b"]).first()["prompt"] == "a b!"


@pytest.mark.parametrize("raw, binary, graded, score", [("1", 1, 1.0, 1.0), ("0", 0, 0.0, 0.0), ("ANSWER: 1", 1, 1.0, 1.0), ("ANSWER: NO", 0, None, 0.0), ("<think>0</think> yes", 1, None, 1.0), ("0.85", None, 0.85, 0.85), (".5", None, 0.5, 0.5), ("80%", None, None, 0.8), ("**no**", 0, None, 0.0), ("<answer>0.3</answer>", None, 0.3, 0.3), ("", None, None, None), ("not a number", None, None, None)])
def test_parsers(spark, raw, binary, graded, score):
    r = one(spark, T.parse_binary(F.lit(raw)), T.parse_graded(F.lit(raw), fallback=False), T.parse_judge_score(F.lit(raw)))
    assert r[2] == score
    if graded is not None:
        assert r[1] == graded
    if raw in ("1", "0", "ANSWER: 1", "ANSWER: NO", "<think>0</think> yes", "**no**"):
        assert r[0] == binary


@pytest.mark.parametrize("raw, score", [("No issues found. 0.9", 0.9), ("7/10 is too high, so 0.2", 0.2), ("80% sure it is not, so 0.1", 0.1), ("85", 1.0), ("TRUE", 1.0), ("Y", 1.0), ("n", 0.0), ("It is between 0 and 1 somewhere", None), ("long story\nthe score is 4.", 0.4), ("x:0.1", 0.1), ("x:0.7", None), ("<think>1</think>", None), ("<answer></answer> 1", None), ("Rating: about 6 of 10", 0.6), ("**Score: 3/4**", 0.75), ("3/0", None), ("No.", 0.0), ("because of that the answer is yes", 1.0), (None, None)])
def test_judge_scores_in_prose(spark, raw, score):
    got = one(spark, T.parse_judge_score(F.lit(raw).cast("string")))[0]
    assert got == score or math.isclose(got, score)


@pytest.mark.parametrize("raw, binary, graded", [("ANSWER - NO, yes it is bad", 0, None), ("level 10", 0, None), ("1.5", 1, 1.0), ("answer: 1 then ANSWER: 0", 0, 1.0), ("result 1", 1, 1.0), ("0.25 or 0.5", 0, 0.25), ("12", None, None), ("yes", 1, None)])
def test_binary_and_graded_in_prose(spark, raw, binary, graded):
    assert tuple(one(spark, T.parse_binary(F.lit(raw)), T.parse_graded(F.lit(raw)))) == (binary, graded)
    assert one(spark, T.parse_graded(F.lit("75"), prefill="0."))[0] == 0.75
    assert one(spark, T.strip_eos(F.lit("a\n</s>\n")), T.strip_eos(F.lit("a </s></s>")), T.strip_eos(F.lit("a \n"))) == ("a", "a </s>", "a")


def test_text(spark):
    r = one(spark, T.simple_tokens(F.lit("Café über a1 dog's_x Cat")), T.count_occurrences(F.lit("cat-Cat scat"), "cat"), T.strip_eos(F.lit("a </s> ")), T.word_ends(F.lit(" ab  c")), T.strip_thinking(F.lit("<think>x</think> a<think>y</think>b")))
    assert [r[0], r[1], r[2], r[3], r[4]] == [["dog", "cat"], 2, "a", [3, 6], "ab"]
    df = spark.createDataFrame([("abcdefghij", 10)], "text string, n_tokens int")
    assert [(x["k"], x["prefix"]) for x in T.prefixes_at_steps(df, step=4).orderBy("k").collect()] == [(4, "abcd"), (8, "abcdefgh"), (10, "abcdefghij")]


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one(spark, V.js(a(1, 0), a(0, 1)), V.kl(a(0.5, 0.5), a(1, 0)), V.mutual_deviance(a(1, 1), a(1, 1)), V.effective_structures(a(0, 0, 0)), V.deviance(a(1, 0), a(0, 0)), V.power_mean(a(0, 4), -1), V.perplexity(F.array().cast("array<double>")))
    assert math.isclose(r[0], math.log(2)) and r[1] == INF and r[2] == 1 and r[3] == 3 and r[4] == 1 and r[5] == 8 and r[6] == INF
    assert one(spark, V.sanitize(F.lit(-INF)), V.safe_float(F.lit("junk"), 2.0)) == (-1000.0, 2.0)


def test_weights_fall_back_to_equal_shares(spark):
    s = systems(spark, [(i, "a", [float(i)], -INF, 0, False, []) for i in range(4)] + [(9, "b", [1.0], -1000.0, 5, False, []), (10, "b", [0.0], -1002.0, 5, False, [])])
    for m in ("prob", "inv-ppl", "uniform"):
        w = {r["traj_idx"]: r["w"] for r in W.with_weight(s, m).collect()}
        assert all(math.isclose(w[i], 0.25) for i in range(4)) and math.isclose(w[9] + w[10], 1)
    assert math.isclose(W.with_weight(s, "prob").where("traj_idx = 9").first()["w"], 1 / (1 + math.exp(-2)))
    e = {r["traj_idx"]: (r["e0"], r["e1"]) for r in W.escort(W.with_weight(s, "prob"), [INF, 0]).collect()}
    assert e[9] == (1.0, 0.5) and e[0] == (0.25, 0.25)


def test_cores_and_estimate(spark):
    s = systems(spark, [(0, "trunk", [0.0, 1.0], -1.0, 2, False, ["a", "b"]), (1, "trunk", [1.0, 1.0], -1.0, 2, False, ["a", "c"]), (2, "trunk", [1.0, 0.0], -1.0, 2, False, ["a", "c", "d"]), (3, "trunk", [9.0, 9.0], 0.0, 2, True, [])])
    rows = s.where("NOT is_greedy")
    named = {(r["variant"], r["struct_idx"]): r["value"] for r in C.named_cores(W.with_weight(rows)).collect()}
    assert math.isclose(named["standard", 0], 2 / 3) and named["max", 0] == 1 and named["geometric", 0] == 1 and named["actual_min", 1] == 1
    assert {r["struct_idx"]: r["value"] for r in C.greedy_core(rows).collect()} == {0: 1.0, 1: 0.0}
    assert {r["value"] for r in C.greedy_core(s).collect()} == {9.0}
    assert {r["method"] for r in C.ensemble_cores(rows).collect()} == {"average", "greedy", "mode", "median"}
    est = D.estimate(s).where("method = 'uniform'").first()
    assert est["n"] == 3 and est["deviance_root"] == 0 and math.isclose(est["deviance_trunk"], est["expected_deviance"])
    assert D.estimate(s.limit(0)).count() == 0


def test_scoring(spark):
    texts = spark.createDataFrame([(0, "a", "The cat of the house"), (1, "a", ""), (2, "a", None)], "traj_idx long, arm string, text string")
    got = {(r["traj_idx"], r["struct_idx"]): r["score"] for r in S.score_count_occurrences(texts, ["the", "of the"]).collect()}
    assert got[0, 0] == 0.4 and got[0, 1] == 0.2 and got[1, 0] == 0
    glossary = spark.createDataFrame([("The",), ("of the",), ("ouse",)], "surface_form string")
    assert {(r[0], r[1]) for r in S.match_glossary(texts, glossary).collect()} == {(0, "The"), (0, "of the")}
    lex = spark.createDataFrame([("cat", 5.0), ("house", -5.0)], "word string, z double")
    s = {r["traj_idx"]: r for r in S.score_lexicon(texts, lex).collect()}
    assert math.isclose(s[0]["score"], 0.5) and s[0]["words_scored"] == 2 and s[1]["total_words"] == 0
    m = spark.createDataFrame([(0, "The", 0.5), (0, "of the", None)], "traj_idx long, surface_form string, p double")
    w = {r["traj_idx"]: (r["score"], r["raw"]) for r in S.score_whistles(texts, m).collect()}
    assert w[0][0] == 0.75 and w[1] == (0.0, "no_matches")
    h = spark.createDataFrame([(0, "x", 0.2), (0, "_", 0.9)], "traj_idx long, hypothesis string, p double")
    assert S.score_hypotheses(h).first()["score"] == 0.2


def test_judges_and_samples(spark):
    j = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, None), ("a", 1, 0, 1.0)], "judge string, traj_idx long, struct_idx int, score double")
    assert [(r["traj_idx"], r["score"]) for r in E.merge_judges(j, 2).collect()] == [(0, 1.0)]
    more = E.append_structures(j, spark.createDataFrame([("a", 0, 0, 0.5)], j.schema), 0)
    assert sorted(r["struct_idx"] for r in more.collect()) == [0, 1, 1, 1]
    s = systems(spark, [(i, "a", [0.0], float(-i), 1, False, []) for i in range(10)])
    assert [r["traj_idx"] for r in E.extremal_rows(s, 4).orderBy("pick").collect()] == [9, 0, 8, 1]
    assert E.attach_greedy(s, s.limit(1)).where("is_greedy").first()["traj_idx"] < 0
    sc = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, None), ("a", 1, 0, 0.0)], "arm string, struct_idx int, item_idx int, score double")
    means = {(r["struct_idx"], r["item_idx"]): r["mean"] for r in Y.arm_structure_means(sc).collect()}
    assert means[0, None] == 1.0 and means[0, 1] is None


def brute_nodes(lists):
    """Prefixes where sequences part, unless a whole sequence is a prefix of it."""
    out = set()
    for x in lists:
        for p in range(len(x)):
            group = [y for y in lists if len(y) > p and y[:p] == x[:p]]
            if len({y[p] for y in group}) > 1 and not any(len(y) <= p and x[: len(y)] == y for y in lists):
                out.add(tuple(x[:p]))
    return out


def test_divergence_nodes_match_brute_force(spark):
    lists = [list("abcd"), list("abce"), list("abx"), list("q"), list("qrs"), list("qrt"), list("abcd"), list("zz"), list("zy")]
    for some in (lists + [[]], lists):  # an empty sequence ends before every node
        nodes = K.divergence_nodes(seqs(spark, some)).collect()
        assert sorted(r["pos"] for r in nodes) == sorted(map(len, brute_nodes(some)))
    assert len(nodes) == 4
    pairs = spark.createDataFrame([("root", "trunk")], "arm_a string, arm_b string")
    assert K.forks_between(seqs(spark, lists), pairs).count() > 0
    assert K.divergence_nodes(seqs(spark, lists).limit(0)).count() == 0


def test_roll_up(spark):
    tree = spark.createDataFrame([(1, None, 0, 1.0, None), (2, 1, 1, 3.0, None), (3, 1, 1, 1.0, 1.0), (4, 2, 2, 1.0, 0.0), (5, 2, 2, 1.0, 1.0)], "node long, parent long, depth int, weight double, score double")
    assert {r["node"]: r["score"] for r in K.roll_up(tree, 2).collect()}[1] == (3 * 0.5 + 1) / 4


def test_moments_merge(spark):
    s = spark.createDataFrame([(0, float(i)) for i in range(10)], "node int, x double")
    both = M.merge_moments(M.moments(s.where("x < 4"), ["node"]), M.moments(s.where("x >= 4"), ["node"]), ["node"]).first()
    whole = M.moments(s, ["node"]).first()
    assert all(math.isclose(both[c], whole[c]) for c in ("n", "mean", "m2"))


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"one, ""two""\nlines",x\n,y\nshort\n b ,z\n')
    assert [(r["arm"], r["text"]) for r in IO.read_labelled_csv(spark, str(tmp_path / "a.csv")).orderBy("traj_idx").collect()] == [("x", 'one, "two"\nlines'), ("z", "b")]
    (tmp_path / "g.json").write_text('{"config": {"arms": ["root", "trunk"]}, "tree": {"trajs": [{"traj_idx": 0, "arm_idx": [1], "token_ids": [1]}, {"traj_idx": 1, "arm_idx": [7]}]}}')
    assert [(r["traj_idx"], r["arm"]) for r in IO.read_generation_json(spark, str(tmp_path / "g.json")).collect()] == [(0, "trunk")]
    (tmp_path / "s.json").write_text('{"results": [{"traj_idx": 0, "arm": "a", "method_scores": {"graded": [0.5, [1, null]]}}]}')
    assert sorted((r["struct_idx"], r["item_idx"], r["score"]) for r in IO.read_scoring_json(spark, str(tmp_path / "s.json")).where("score IS NOT NULL").collect()) == [(0, 0, 0.5), (1, 0, 1.0)]
    (tmp_path / "l.json").write_text('{"delta": {"a": 1.5}}')
    assert IO.read_lexicon(spark, str(tmp_path / "l.json")).first()["z"] == 1.5
    (tmp_path / "w.json").write_text('[{"term": "t", "whistle_type": "I"}, {"surface_form": "s"}]')
    assert {(r["surface_form"], r["type"]) for r in IO.read_glossary(spark, str(tmp_path / "w.json")).collect()} == {("t", "I"), ("s", "II")}
    with pytest.raises(ValueError, match="missing"):
        IO.merge_arm_partitions({}, ["a"])


def test_registry(spark):
    texts = spark.createDataFrame([(0, "ab"), (1, None)], "traj_idx long, text string")
    R.SCORING.pop("len", None)
    R.register_scoring_method("len", "l", lambda t, i: t.crossJoin(i).withColumn("score", F.char_length("text").cast("double")))
    items = spark.createDataFrame([(0, 0), (0, 1)], "struct_idx int, item_idx int")
    assert R.score_texts(texts, {"len": items}).count() == 4
    scored = R.score_with_model(texts.fillna("", ["text"]), lambda: lambda s: s.str.len().astype(float))
    assert [r["score"] for r in scored.orderBy("traj_idx").collect()] == [2.0, 0.0]
    assert R.resume(items.selectExpr("struct_idx AS traj_idx", "item_idx"), spark.createDataFrame([(0, 0)], "traj_idx int, item_idx int")).count() == 1


def test_running_stats_of_a_node_in_many_tasks(spark):
    rng = np.random.default_rng(5)
    x = 1e6 + rng.normal(size=3000)
    rows = [(0, i, float(v) if i % 11 else None) for i, v in enumerate(x)] + [(k, 0, 0.5) for k in range(1, 5)] + [(9, 0, None), (9, 1, 2.0)]
    df = spark.createDataFrame(rows, "node int, i int, x double").repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r["node"], r["i"]): (r["n"], r["mean"], r["std"]) for r in M.running_stats(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i in (0, 1, 5, 700, 1500, 2999):
        seen = np.array([v for j, v in enumerate(x[: i + 1]) if j % 11])
        n, mean, std = got[0, i]
        assert n == len(seen)
        if n:
            assert abs(mean - seen.mean()) < 1e-7 and abs(std - seen.std()) < 1e-6
        else:
            assert mean is None and std is None
    assert got[9, 0] == (0, None, None) and got[9, 1] == (1, 2.0, 0.0) and got[3, 0] == (1, 0.5, 0.0)


def test_logit_density_against_single_kernels(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.random(400), "b": np.append(rng.beta(2, 9, 300), [0.0, 1.0]), "c": np.array([0.3, 0.3]), "d": np.array([0.2, 0.9])}
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [("a", None)]
    got = C.logit_kde(spark.createDataFrame(rows, "arm string, x double"), ("arm",), points=201).toPandas()
    grid = np.arange(1, 202) / 202
    for k, g in groups.items():
        y = np.clip(g, 1e-6, 1 - 1e-6)
        z, at = np.log(y / (1 - y)), np.log(grid / (1 - grid))
        want = np.zeros(201)
        if len(set(g)) > 1:
            h = (len(z) * 0.75) ** -0.2 * z.std(ddof=1)
            want = np.exp(-(((at[:, None] - z) / h) ** 2) / 2).sum(1) / (len(z) * h * np.sqrt(2 * np.pi)) / (grid * (1 - grid))
        own = got[got["arm"] == k].sort_values("y")["density"].to_numpy()
        assert np.abs(own - want).max() < 1e-8


def brute_tree(seqs):
    tree = {}
    for i, t in seqs:
        for p in range(len(t)):
            tree.setdefault(tuple(t[: p + 1]), []).append(i)
    return tree


def test_trees_over_many_partitions(spark):
    """Runs of rows that reach over partitions, ended prefixes, equal rows and odd words, against brute force."""
    rng = random.Random(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in (1, 5, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            base, rows = [rng.choice("ab") for _ in range(12)], []
            for i in range(60):
                t = base[: rng.randint(0, 12)] + [rng.choice(["a", "\x00", "\x01b", "", "ab"]) for _ in range(rng.randint(0, 4))]
                rows.append((i, t + [["x"], ["y"]][i % 2] if parts == 5 else t or ["q"]))
            df = spark.createDataFrame(rows, "traj_idx long, tokens array<string>")
            tree, whole = brute_tree(rows), {tuple(t) for _, t in rows}
            kids = {}
            for p in tree:
                kids.setdefault(p[:-1], set()).add(p[-1])
            nodes = {p: len(w) for p, w in kids.items() if len(w) > 1 and not any(p[:k] in whole for k in range(len(p) + 1))}
            assert sorted((r["pos"], r["n_branches"]) for r in K.divergence_nodes(df).collect()) == sorted((len(p), n) for p, n in nodes.items())
            got = {r["node"]: r for r in K.word_tree(df).collect()}
            name = lambda n: () if n == 0 else (*name(got[n]["parent"]), got[n]["word"])  # noqa: E731, B023
            assert {name(n): (r["depth"], r["n"], r["is_leaf"], r["is_end"]) for n, r in got.items()} == {p: (len(p) - 1, len(x), p not in kids, p in whole) for p, x in tree.items()}  # noqa: B023
            kept = {p for p in tree if p in whole or len(kids[p]) > 1}
            for r in K.compressed_tree(df).collect():
                p = name(r["node"])
                above = [q for q in kept if len(q) < len(p) and p[: len(q)] == q]
                assert p in kept and name(r["parent"]) == max(above, key=len, default=()) and (r["depth"], r["end"]) == (len(above) + 1, len(p))
                kept_seen = True
            assert kept_seen and K.compressed_tree(df).count() == len(kept)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert K.word_tree(df.limit(0)).count() == 0 and K.sentence_tree(df.limit(0).withColumn("text", F.lit("x"))).count() == 0


def test_sentence_tree(spark):
    texts = ["the cat sat", "the cat  ran home", "the dog", "the cat sat", None, " "]
    rows = [tuple(r) for r in K.sentence_tree(spark.createDataFrame([(t,) for t in texts], "text string")).orderBy("node").collect()]
    assert rows == [
        (0, "root", None, 0, "root", 4, False), (1, "trunk", 0, 1, "the", 4, False), (2, "node_2", 1, 2, "cat", 3, False),
        (3, "node_3", 2, 3, "ran home", 1, True), (4, "node_4", 2, 3, "sat", 2, True), (5, "node_5", 1, 2, "dog", 1, True),
    ]
    numbers = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 5]), (2, [10, 2])], "traj_idx long, tokens array<int>")
    assert sorted((r["pos"], r["token"]) for r in K.node_branches(numbers).collect()) == [(0, 1), (0, 10), (1, 2), (1, 5)]
