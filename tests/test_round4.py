"""Findings of round 4: walks with many partings, forks of texts that part early."""

import random

from pyspark.sql import functions as F

from normscape.operators import cores as C
from normscape.operators import prefixes as P
from normscape.operators import trees as K


def _walked(rows, max_steps=None):
    """The walk a token at a time, of each arm."""
    out = {}
    for arm in {a for _, a, _ in rows}:
        left, pos = [(i, t) for i, a, t in rows if a == arm and t], 0
        while any(len(t) > pos for _, t in left) and pos != max_steps:
            going = [t[pos] for _, t in left if len(t) > pos]
            win = min(going, key=lambda w: (-going.count(w), w))
            left, pos = [(i, t) for i, t in left if len(t) > pos and t[pos] == win], pos + 1
        if left:
            out[arm] = min((-len(t), i) for i, t in left)[1]
    return out


def test_walk_over_many_partings_takes_few_jobs(spark, monkeypatch):
    stem = [f"w{i % 5}" for i in range(80)]
    rows = [(i, "ab"[i % 2], [*stem[:i], "z" if i % 3 else "a", *stem[i + 1 :]]) for i in range(12)] + [(40, "a", stem), (41, "b", stem)]
    seqs = spark.createDataFrame(rows, "traj_idx long, arm string, tokens array<string>")
    calls, settle = [], C.settled
    monkeypatch.setattr(C, "settled", lambda df: calls.append(1) or settle(df))
    assert {r["arm"]: r["traj_idx"] for r in C.majority_walk(seqs).collect()} == _walked(rows)
    assert len(calls) < 8


def test_walks_over_the_edges_of_partitions(spark, monkeypatch):
    for seed in range(3):
        monkeypatch.setattr(P, "_ROWS", (3, 7, 20)[seed])
        rnd = random.Random(seed)
        stems = [[rnd.randrange(9, 12) for _ in range(rnd.randrange(3, 25))] for _ in range(5)]
        near = lambda t: [x if rnd.random() > 0.05 else rnd.randrange(8, 103) for x in t[: rnd.randrange(len(t) // 2, len(t) + 1)]]
        rows = [(i, rnd.choice(["a", "a", "a", "b", "c", f"d{i % 30}", None]), near(rnd.choice(stems))) for i in range(220)]
        rows += [(i + 300, "a", rows[i % 9][2]) for i in range(40)] + [(400, "e", [])]
        numbers = spark.createDataFrame(rows, "traj_idx long, arm string, tokens array<long>")
        words = [(i, a, [str(x) for x in t]) for i, a, t in rows]  # 9 is after 10 here
        strings = spark.createDataFrame(words, "traj_idx long, arm string, tokens array<string>")
        for steps in (None, 0, 3):
            assert {r["arm"]: r["traj_idx"] for r in C.majority_walk(numbers, max_steps=steps).collect()} == _walked(rows, steps)
            assert {r["arm"]: r["traj_idx"] for r in C.majority_walk(strings, max_steps=steps).collect()} == _walked(words, steps)


def _forks(rows, pairs):
    """(pos, arm_a, arm_b, token_a, token_b): nodes, by all prefixes, above which no text has ended."""
    whole, nodes, out = {tuple(t) for _, _, t in rows}, {}, {}
    for _, arm, t in rows:
        for k in range(len(t)):
            nodes.setdefault(tuple(t[:k]), {}).setdefault(arm, set()).add(t[k])
    for p, arms in nodes.items():
        if not any(p[:k] in whole for k in range(len(p) + 1)):
            for a, b in pairs:
                for x in arms.get(a, ()):
                    for y in arms.get(b, set()) - {x}:
                        out[len(p), a, b, x, y] = out.get((len(p), a, b, x, y), 0) + 1
    return out


def test_forks_sort_texts_that_part_early_by_their_beginnings(spark, monkeypatch):
    monkeypatch.setattr(P, "_HEAD", 4)
    rnd, pairs = random.Random(1), [("a", "b"), ("b", "c")]
    tail = [f"t{i}" for i in range(60)]
    rows = [(i, "abc"[i % 3], [f"w{rnd.randrange(40)}", f"x{rnd.randrange(9)}", f"{i}", *tail]) for i in range(200)]
    for i in range(40):  # near copies, some of which part late, and exact ones, in one arm and in several
        cut = rnd.randrange(len(tail))
        rows += [(500 + i, rnd.choice("abc"), [*rows[0][2][:3], *tail[:cut], "other", *tail[cut + 1 :]])]
        rows += [(600 + i, rnd.choice("abc"), rows[rnd.randrange(30)][2])]
    rows += [(700 + i, rnd.choice("abc"), ["w1", *(f"y{x}" for x in range(i % 7))]) for i in range(30)]  # shorter, about and longer than 4
    rows += [(800, "a", ["m", "n", "o"]), (801, "b", ["m", "n", "o", "p", "q"]), (802, "a", ["m", "n", "o", "p", "r"]), (803, "c", ["m", "n", "o", "p"])]
    seqs = spark.createDataFrame(rows, "traj_idx long, arm string, tokens array<string>")
    seqs = seqs.unionByName(spark.createDataFrame([(900, "a", None)], seqs.schema))
    table = spark.createDataFrame(pairs, "arm_a string, arm_b string")
    assert {tuple(r)[:5]: r["n"] for r in K.fork_counts(seqs, table).collect()} == _forks(rows, pairs)
    sorted_, before = [], P._sorted
    monkeypatch.setattr(P, "_sorted", lambda s, *a: sorted_.append(before(s, *a)) or sorted_[0])
    K.forks_between(seqs, table)
    size = sorted_[0].select(F.sum("n")).first()[0]
    assert size < sum(len(t) for _, _, t in rows) / 2


def test_pairs_of_words_at_one_node_are_not_counted(spark):
    rows = [(i, "ab"[i % 2], [f"w{i // 4}", f"v{i}" if i % 4 < 2 else f"u{i % 4}"]) for i in range(80)]
    seqs = spark.createDataFrame(rows, "traj_idx long, arm string, tokens array<string>")
    pairs = spark.createDataFrame([("a", "b")], "arm_a string, arm_b string")
    deep = K._fork_lists(seqs, pairs).where("pos = 1").groupBy("alone").agg(F.sum(F.size("tokens_a") * F.size("tokens_b")).alias("n")).collect()
    assert {r["alone"]: r["n"] for r in deep} == {True: 60, False: 20}
    assert {tuple(r)[:5]: r["n"] for r in K.fork_counts(seqs, pairs).collect()} == _forks(rows, [("a", "b")])
