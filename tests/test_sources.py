"""Large JSON documents read in parallel, and broadcasts of a checked size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from normscape.functions import arms as A
from normscape.operators import ranking as RK
from normscape.operators import weights as W
from normscape.sources import shared as SH
from normscape.sources import tables as IO
from normscape.sources.json_parts import json_values


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_of_a_document_in_many_splits(spark, tmp_path, indent):
    rng = random.Random(1)
    trajs = [{"traj_idx": i, "s": rng.choice(["a}b", '{"', "q\\", '\\"}', "é[{", "x\ny", "]}"]), "n": {"a": [{"z": 1}, {}], "b": "}"}, "l": list(range(rng.randint(0, 9)))} for i in range(40)]
    doc = {"meta": {"tree": {"trajs": [{"no": 1}]}}, "config": {"arms": ["tr}unk", "b"], "x": {"y": [{}]}}, "tree": {"other": [{"a": {}}], "trajs": trajs, "z": {}}, "results": [{"k": k} for k in range(7)]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"results": [], "tree": {"trajs": trajs[:3]}}))
    (tmp_path / "c.json").write_text("{}")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        found = [t.orderBy("file", "nth").collect() for t in json_values(spark, str(tmp_path), ("tree", "trajs"), ("results",), ("config",))]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    read = lambda rows, file: [json.loads(r["value"]) for r in rows if r["file"].endswith(file)]
    assert read(found[0], "a.json") == trajs and read(found[0], "b.json") == trajs[:3] and not read(found[0], "c.json")
    assert read(found[1], "a.json") == doc["results"] and not read(found[1], "b.json")
    assert read(found[2], "a.json") == [doc["config"]]


def test_running_sums_do_not_carry_the_text(spark, tmp_path):
    rng = random.Random(2)
    trajs = [{"traj_idx": i, "generated_text": rng.randbytes(4000).hex() + "}"} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps({"config": {"arms": ["trunk"]}, "tree": {"trajs": trajs}}))
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = lambda: jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))
    shuffled = lambda: sum(x.shuffleWriteBytes() for x in stages())
    before = shuffled()
    (found,) = json_values(spark, str(tmp_path), ("tree", "trajs"))
    assert [json.loads(r["value"]) for r in found.orderBy("nth").collect()] == trajs
    assert shuffled() - before < 2.5 * (tmp_path / "a.json").stat().st_size


def test_results_are_needed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": []}')
    with pytest.raises(ValueError, match="no results"):
        IO.read_scoring_json(spark, str(tmp_path / "a.json"))


def test_only_small_tables_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(SH.small(spark.range(10)))
    assert "broadcast" not in plan(SH.small(spark.range(20_001)))
    assert "broadcast" not in plan(SH.small(spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t")), most=5000))


def test_arm_trees_need_counts_and_probabilities(spark):
    rows = lambda *r: spark.createDataFrame(r, "arm string, n_traj int, p_given_parent double")
    tree = A.arm_tree(rows(("root", 1, 1.0), ("branch_1", 2, 0.5), ("twig_b1_1", 3, 0.1), ("twig_b9_1", 4, 0.2)))
    assert {tuple(r) for r in tree.collect()} == {(None, "root", 1, 1.0), ("root", "branch_1", 2, 0.5), ("branch_1", "twig_b1_1", 3, 0.1)}
    for bad, what in ((rows(("root", 1, 1.0), ("branch_1", None, 0.5)), "branch_1"), (rows(("branch_1", 1, 1.0)), "neither root nor trunk")):
        with pytest.raises(Exception, match=what):
            A.arm_tree(bad).collect()
    with pytest.raises(ValueError, match="no arm 'x'"):
        A.filter_arm(rows(("root", 1, 1.0)), "x")


def test_rows_of_arms(spark):
    rows = [(0, "a", -1.0, 2), (1, "a", -1.0, 0), (2, "a", -800.0, 3), (3, "b", None, None), (4, "c", -900.0, 5)]
    got = {r["traj_idx"]: r for r in RK.ranked_arm_rows(spark.createDataFrame(rows, "traj_idx int, arm string, logprob double, n_tokens int")).collect()}
    assert [got[i]["rank"] for i in range(5)] == [1, 2, 3, 1, 1] and abs(got[0]["p_norm"] - 0.5) < 1e-9 and got[2]["p"] == 0
    assert got[0]["inv_ppl_share"] == 1 and got[1]["ppl"] is None and got[2]["ppl"] is None and got[4]["inv_ppl_share"] is None
    conditional = spark.createDataFrame([(1, "branch_1", {"trunk": -3.0, "branch_1": -1.0}), (0, "branch_1", {"trunk": -2.0, "branch_1": -1.0}), (0, "trunk", {"trunk": -2.0}), (0, "branch_2", {"trunk": -2.0})], "traj_idx int, arm string, conditional map<string, double>")
    assert [(r["arm"], round(r["p0"], 6)) for r in W.arm_p0(conditional).collect()] == [("branch_1", 0.367879)]
