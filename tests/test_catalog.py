import pytest

from normscape.plans import catalog
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_trees_and_walk_over_whole_texts(spark, tmp_path):
    stem = [f"w{i % 7}" for i in range(50)]
    texts = [[*stem, "a"], [*stem, "b", "c"], [*stem, "b", "d", *stem * 100], [*stem, "b", "d", *stem * 100, "z"], ["x", *stem], [*stem, "b", "d", *stem * 100, "y", "y"], ["x", *stem, "q"]]
    spark.createDataFrame([(4 * i, " ".join(t), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    tree, nodes = {}, {}
    for i, t in enumerate(texts):
        for p in range(len(t)):
            tree.setdefault(tuple(t[: p + 1]), []).append(len(t) == p + 1)
            nodes.setdefault(tuple(t[:p]), []).append((t[p], 4 * i))
    whole = set(map(tuple, texts))
    nodes = {p: r for p, r in nodes.items() if len({w for w, _ in r}) > 1 and not any(p[:k] in whole for k in range(len(p) + 1))}
    assert sorted(got("K10_word_tree")) == sorted((len(p) - 1, p[-1], len(e), all(e)) for p, e in tree.items())
    assert sorted(got("K1_divergence_nodes")) == sorted((len(p), len({w for w, _ in r}), len(r), 1) for p, r in nodes.items())
    branches = [(len(p), w, sum(x == w for x, _ in r), min(i for x, i in r if x == w)) for p, r in nodes.items() for w in {x for x, _ in r}]
    assert sorted(got("K2_node_branches")) == sorted(branches)
    hits = {i: ",".join(str(len(p)) for p in sorted(nodes, key=len) if any(i == x for _, x in nodes[p])) for i in {i for r in nodes.values() for _, i in r}}
    assert dict(got("K3_nodes_of_trajectory")) == hits
    left, pos = list(range(len(texts))), 0
    while any(len(texts[i]) > pos for i in left):
        going = [texts[i][pos] for i in left if len(texts[i]) > pos]
        win = min(going, key=lambda w: (-going.count(w), w))
        left, pos = [i for i in left if len(texts[i]) > pos and texts[i][pos] == win], pos + 1
    assert got("G10_majority_walk") == [("root", 4 * left[0])] == [("root", 20)]
