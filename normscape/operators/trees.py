"""Prefix trees as tables: nodes are runs of sorted sequences (see prefixes), named by first row and length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from normscape.operators.prefixes import compressed, node_id, paths, shortened
from normscape.operators.ranking import ranked
from normscape.operators.weights import join_groups
from normscape.sources.shared import settled, small


def add_trajectories(seqs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequences of both, and the pairs (arm_a, arm_b) that are new: each arm there was with each that came."""
    pairs = groups(seqs).withColumnRenamed("arm", "arm_a").join(small(groups(new).withColumnRenamed("arm", "arm_b")), F.col("arm_a") != F.col("arm_b"))
    return seqs.unionByName(new), pairs


def groups(seqs: DataFrame) -> DataFrame:
    """(arm): the arms of a set of sequences."""
    return seqs.select("arm").distinct()


def _partings(seqs: DataFrame, keep: tuple = ("traj_idx",), kind: DataType | None = None) -> DataFrame:
    """(keep.., prefix, pos, token): each sequence at each node where sequences part and no ended one is above."""
    kind = kind or seqs.schema["tokens"].dataType.elementType
    open_ = F.filter("nodes", lambda x: (x["pos"] < F.col("stop")) & x["token"].isNotNull())
    rows = paths(seqs, keep).select(*keep, F.explode(open_).alias("x"))
    return rows.select(*keep, node_id(F.col("x.lo"), F.col("x.pos")).alias("prefix"), F.col("x.pos").alias("pos"), F.col("x.token").cast(kind).alias("token"))


def divergence_nodes(seqs: DataFrame) -> DataFrame:
    """(prefix, pos, n_branches, n_rows): positions where sequences with one prefix part.

    A prefix that is itself a whole sequence, and all below it, gives no node.
    """
    return node_branches(seqs).groupBy("prefix", "pos").agg(F.count("*").alias("n_branches"), F.sum("n").alias("n_rows"))


def node_branches(seqs: DataFrame) -> DataFrame:
    """(prefix, pos, token, n, first_traj): the branches of each node, to be ordered by first_traj."""
    return _partings(seqs).groupBy("prefix", "pos", "token").agg(F.count("*").alias("n"), F.min("traj_idx").alias("first_traj"))


def nodes_of_trajectory(seqs: DataFrame) -> DataFrame:
    """(traj_idx, positions): where each sequence branches."""
    at = F.transform(F.filter("nodes", lambda x: (x["pos"] < F.col("stop")) & x["token"].isNotNull()), lambda x: x["pos"])
    return paths(seqs).select("traj_idx", at.alias("positions")).where(F.size("positions") > 0)


#: Words of one list of an arm's branches at a node, on average; and pairs of words written by a task.
_LISTED, _PAIRS = 512, 2_000_000


def _fork_lists(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(prefix, pos, arm_a, arm_b, tokens_a, tokens_b, alone): lists of branches of the arms of each pair that meet at a node.

    Each list of the one arm meets each of the other once, so all pairs of branches are there, though a node with very many
    has as many rows as it has pairs of lists, dealt over tasks by how many pairs of words they are. alone: no other node
    has a word of the one list at this pos in its arm, so none has these pairs.
    """
    at = ["prefix", "pos", "arm"]
    word = ["pos", "arm", "token"]
    own = settled(_partings(shortened(seqs), ("arm",), seqs.schema["tokens"].dataType.elementType).distinct())
    nodes = settled(own.groupBy(*word).agg(F.min("prefix").alias("prefix"), F.max("prefix").alias("__other")))
    single = nodes.where("prefix = __other").select(*at, "token", F.lit(True).alias("single"))
    several = own.join(small(nodes.where("prefix < __other").select(*word), 200_000), word, "left_semi").select(*at, "token", F.lit(False).alias("single"))
    own = single.unionByName(several)
    at = [*at, "single"]
    rows = join_groups(own, own.groupBy(*at).agg(F.ceil(F.count("*") / _LISTED).alias("__lists")), at)
    lists = rows.groupBy(*at, F.pmod(F.xxhash64("token"), F.col("__lists")).alias("__list")).agg(F.collect_list("token").alias("tokens"))
    lists = settled(lists.drop("__list"))
    a = lists.select("prefix", "pos", F.col("arm").alias("arm_a"), F.col("tokens").alias("tokens_a"), F.col("single").alias("__a")).join(small(pairs), "arm_a")
    b = lists.select("prefix", "pos", F.col("arm").alias("arm_b"), F.col("tokens").alias("tokens_b"), F.col("single").alias("__b"))
    met = settled(a.join(b, ["prefix", "pos", "arm_b"]).withColumn("alone", F.col("__a") | F.col("__b")).drop("__a", "__b"))
    total = met.agg(F.sum(F.size("tokens_a").cast("long") * F.size("tokens_b"))).first()[0] or 0
    tasks = max(seqs.sparkSession.sparkContext.defaultParallelism, min(-(-total // _PAIRS), 20_000))
    return met.repartition(tasks)


def _fork_pairs(lists: DataFrame) -> DataFrame:
    keep = ["prefix", "pos", "arm_a", "arm_b"]
    rows = lists.select(*keep, "tokens_b", F.explode("tokens_a").alias("token_a"))
    # a word is taken out of the other list at once, which costs less than a look at each pair
    return rows.select(*keep, "token_a", F.explode(F.array_remove("tokens_b", F.col("token_a"))).alias("token_b"))


def forks_between(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(prefix, pos, arm_a, arm_b, token_a, token_b): branches of the two arms of each pair that differ at a node."""
    return _fork_pairs(_fork_lists(seqs, pairs))


def fork_counts(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pos, arm_a, arm_b, token_a, token_b, n): nodes with a fork of forks_between(); all its pairs, so quadratic in branches.

    A pair with a word that its arm has at one node of this position alone is there once, and is not sent on to be counted.
    """
    lists = _fork_lists(seqs, pairs)
    keys = ["pos", "arm_a", "arm_b", "token_a", "token_b"]
    once = _fork_pairs(lists.where("alone")).select(*keys, F.lit(1).cast("long").alias("n"))
    return once.unionByName(_fork_pairs(lists.where("NOT alone")).groupBy(*keys).agg(F.count("*").alias("n")))


def qualifying_forks(alternatives: DataFrame, max_alt: int = 2, min_prob: float = 0.2, min_entropy: float = 1.75) -> DataFrame:
    """Of (traj_idx, pos, token, prob, entropy, is_greedy): the max_alt likeliest tokens, the greedy one then left out."""
    w = Window.partitionBy("traj_idx", "pos").orderBy(F.desc("prob"), "token")
    ranked = alternatives.where(F.col("entropy") >= min_entropy).withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") <= max_alt) & (F.col("prob") >= min_prob) & ~F.col("is_greedy"))


def best_expansion_points(entropies: DataFrame, used: DataFrame, k: int) -> DataFrame:
    """The k unused (traj_idx, pos) of the highest entropy; ties in order."""
    return entropies.join(used, ["traj_idx", "pos"], "left_anti").orderBy(F.desc("entropy"), "traj_idx", "pos").limit(k)


#: Columns of sequences of which a node shows the best value over those through it, and its name there.
_BEST = {"logprob": "prob", "is_greedy": "is_greedy"}


def _best(seqs: DataFrame) -> dict[str, Column]:
    """The largest probability, and whether a sequence is greedy, as far as seqs has them."""
    return {name: F.exp(F.max(c)) if c == "logprob" else F.max(c) for c, name in _BEST.items() if c in seqs.columns}


def word_tree(seqs: DataFrame) -> DataFrame:
    """(node, parent, depth, word, n, is_leaf, is_end[, prob][, is_greedy]): the prefix tree of word sequences with counts.

    Sequences with a logprob give each node the largest probability of those through it, those with is_greedy a flag. The
    tree is worked out compressed, and each edge takes its words from the first sequence that has it. The root, 0, has no
    row; depth counts from 0 below it.
    """
    best = _best(seqs)
    walked = settled(paths(seqs, tuple(c for c in _BEST if c in seqs.columns), with_rest=True))
    edges = compressed(seqs, best, walked)
    words = walked.select(F.col("k").alias("lo"), F.coalesce("lcp", F.lit(0)).alias("__lcp"), "rest")
    own = F.slice("rest", F.col("parent_pos") - F.col("__lcp") + 1, F.col("pos") - F.col("parent_pos"))
    given = ["lo", "pos", "parent_lo", "parent_pos", "n", "is_leaf", "is_end", *best]
    rows = edges.join(words, "lo").select(*given, F.posexplode(own).alias("__i", "word"))
    length = F.col("parent_pos") + F.col("__i") + 1
    parent = F.when(F.col("__i") == 0, node_id(F.col("parent_lo"), F.col("parent_pos"))).otherwise(node_id(F.col("lo"), length - 1))
    last = length == F.col("pos")
    kind = seqs.schema["tokens"].dataType.elementType
    return rows.select(node_id(F.col("lo"), length).alias("node"), parent.alias("parent"), (length - 1).alias("depth"), F.col("word").cast(kind).alias("word"), "n", (F.col("is_leaf") & last).alias("is_leaf"), (F.col("is_end") & last).alias("is_end"), *best)


def compressed_tree(seqs: DataFrame) -> DataFrame:
    """(node, parent, depth, start, end, n, is_leaf, is_end[, prob][, is_greedy]): nodes that branch or end alone.

    This is collapse_chains() of word_tree(), without the tree of all words: the node's own words are those from start up
    to end of any sequence through it, depth counts nodes from the root, which is 0 and has no row.
    """
    best = _best(seqs)
    edges = compressed(seqs, best)
    return edges.select(node_id(F.col("lo"), F.col("pos")).alias("node"), node_id(F.col("parent_lo"), F.col("parent_pos")).alias("parent"), "depth", F.col("parent_pos").alias("start"), F.col("pos").alias("end"), "n", "is_leaf", "is_end", *best)


def sentence_tree(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, name, parent, depth, label, n, is_end): the compressed tree of sentences, cut at word boundaries.

    Node 0 is the root, and a beginning that all share the trunk; the others are numbered in depth-first order. A label is
    the node's own words. White space parts words, however long; null and blank texts are left out, no text gives no tree.
    """
    words = F.split(F.trim(F.regexp_replace(text_col, "\\s+", " ")), " ")
    seqs = texts.where(F.trim(F.regexp_replace(text_col, "\\s+", " ")) != "").select(words.alias("tokens"))
    walked = settled(paths(seqs, (), with_rest=True))
    first = walked.select(F.col("k").alias("lo"), F.coalesce("lcp", F.lit(0)).alias("__lcp"), "rest")
    own = F.slice("rest", F.col("parent_pos") - F.col("__lcp") + 1, F.col("pos") - F.col("parent_pos"))
    edges = compressed(seqs, walked=walked).join(first, "lo").withColumn("label", F.array_join(own, " ")).drop("rest", "__lcp")
    numbered = settled(ranked(edges, [], [F.col("lo"), F.col("pos")], "node"))
    above = numbered.select(F.col("lo").alias("parent_lo"), F.col("pos").alias("parent_pos"), F.col("node").alias("parent"))
    total = walked.agg(F.count("*").alias("__all"))
    rows = numbered.join(above, ["parent_lo", "parent_pos"], "left").crossJoin(F.broadcast(total))  # one row
    name = F.when(F.col("n") == F.col("__all"), "trunk").otherwise(F.concat(F.lit("node_"), F.col("node")))
    rows = rows.select("node", name.alias("name"), F.coalesce("parent", F.lit(0)).alias("parent"), "depth", "label", "n", "is_end")
    root = total.where("__all > 0").select(F.lit(0).cast("long").alias("node"), F.lit("root").alias("name"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.lit("root").alias("label"), F.col("__all").alias("n"), F.lit(False).alias("is_end"))
    return root.unionByName(rows)


def kept_nodes(tree: DataFrame) -> DataFrame:
    """Nodes that branch or end: those a compressed tree keeps."""
    children = tree.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return tree.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).where("n_children <> 1 OR is_end")


def along_path(tree: DataFrame, value: Column, merge: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """(node, out): value folded over each node and all above it. tree: node, parent; merge: (nearer, farther).

    Paths double in each round, so a tree takes as many rounds as its depth has binary digits.
    """
    state = settled(tree.select("node", F.col("parent").alias("up"), value.alias("v")))
    while True:
        far = state.select(F.col("node").alias("up"), F.col("up").alias("__next"), F.col("v").alias("__v"), F.lit(True).alias("__there"))
        merged = F.when(F.col("__there"), merge(F.col("v"), F.col("__v"))).otherwise(F.col("v"))
        # rows that have reached the top stay out of the join, where their null key would be one task's
        going = state.where("up IS NOT NULL").join(far, "up", "left").select("node", F.col("__next").alias("up"), merged.alias("v"))
        state = settled(state.where("up IS NULL").unionByName(going))
        if state.where("up IS NOT NULL").isEmpty():
            return state.select("node", F.col("v").alias(out))


def propagate_logprob(tree: DataFrame, logprob: str = "logprob") -> DataFrame:
    """(node, logprob): the sum from the root down to each node."""
    return along_path(tree, F.col(logprob), lambda a, b: a + b, "logprob")


def word_tree_sums(seqs: DataFrame, value: Callable[[Column], Column]) -> DataFrame:
    """(node, depth, total): propagate_logprob() of a value of each word over word_tree(), the same nodes and sums.

    The nodes that have one first sequence are a chain, its words after those shared with the row before. So sums down to the
    nodes where chains begin are propagated, a row a sequence, and each chain adds its own words to that: words are never
    rows until the result.
    """
    walked = paths(seqs, (), with_rest=True).where(F.size("rest") > 0)
    start = F.coalesce("lcp", F.lit(0))
    up = F.when(start > 0, F.get(F.filter("nodes", lambda x: x["pos"] == start), F.lit(0))["lo"])
    chains = settled(walked.select("k", start.alias("start"), up.alias("up"), F.transform("rest", lambda w: value(w).cast("double")).alias("values")))
    begun = chains.where("up IS NOT NULL").select(F.col("up").alias("lo"), F.col("start").alias("pos")).distinct()
    upto = F.aggregate(F.slice("values", F.lit(1), F.col("pos") - F.col("start")), F.lit(0.0), lambda a, x: a + x)
    sums = begun.join(chains.select(F.col("k").alias("lo"), "start", "values"), "lo").select(F.col("lo").alias("up"), F.col("pos").alias("start"), upto.alias("v"))
    above = chains.select("k", "up", "start").join(sums, ["up", "start"], "left").select(F.col("k").alias("node"), F.col("up").alias("parent"), F.coalesce("v", F.lit(0.0)).alias("v"))
    base = propagate_logprob(above, "v").select(F.col("node").alias("k"), F.col("logprob").alias("base"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, words = [], 0
            for k, first, before, own in zip(b.column("k").to_pylist(), b.column("start").to_pylist(), b.column("base").to_pylist(), b.column("values")):
                x = own.values.to_numpy(zero_copy_only=False)
                depth = np.arange(first, first + len(x), dtype=np.int32)
                made.append(((k << 24) + depth.astype(np.int64) + 1, depth, before + np.cumsum(x)))
                words += len(x)
                if words > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=["node", "depth", "total"])
                    made, words = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=["node", "depth", "total"])

    return chains.join(base, "k").select("k", "start", "base", "values").mapInArrow(add_up, "node long, depth int, total double")


def subtree_ids(tree: DataFrame, root: int) -> DataFrame:
    """(node): a node and all below it."""
    return along_path(tree, F.col("node") == root, lambda a, b: a | b, "inside").where("inside").select("node")


def collapse_chains(tree: DataFrame) -> DataFrame:
    """kept_nodes() of a word_tree() with parent: the nearest kept node above, null at the top."""
    kept = kept_nodes(tree)
    above = kept.select(F.col("node").alias("parent"), F.col("node").alias("__kept"))
    linked = tree.select("node", "parent").join(above, "parent", "left")
    nearest = along_path(linked, F.col("__kept"), lambda a, b: F.coalesce(a, b), "__parent")
    return kept.join(nearest, "node").withColumn("parent", F.col("__parent")).drop("__parent")


def roll_up(tree: DataFrame, max_depth: int) -> DataFrame:
    """(node, score): leaf scores, and for the others the weighted mean of the children, bottom up by level.

    tree: node, parent, depth, weight, score (null inside). A weight sum of 0 divides by 1.
    """
    done = tree.where("score IS NOT NULL").select("node", "parent", "depth", "weight", "score")
    for depth in range(max_depth - 1, -1, -1):
        w = F.sum("weight")
        up = done.where(F.col("depth") == depth + 1).groupBy(F.col("parent").alias("node")).agg((F.sum(F.col("weight") * F.col("score")) / F.when(w == 0, 1.0).otherwise(w)).alias("score"))
        level = tree.where((F.col("depth") == depth) & F.col("score").isNull()).drop("score").join(up, "node")
        done = done.unionByName(level.select("node", "parent", "depth", "weight", "score"))
        if depth % 4 == 0:
            done = settled(done)
    return done.select("node", "score")
