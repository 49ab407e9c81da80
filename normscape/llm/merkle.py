"""Operator 11: a Merkle manifest of a dataset by cogrouped subtree exchange.

Rows become leaves in the JVM, so texts are read once and go no further. Leaves are numbered within their tree by range
partitions (no task sees a whole tree) and dealt to superblocks of FAN ** LEVELS neighbours. Going up, a superblock gives
its one root; going down, its leaves are cogrouped with the outer nodes that it needs, the siblings of its path to the
root, and one applyInPandas finishes the local reduction, joins the proofs and folds them. Trees of superblock roots, and
the tree of subroots, are worked on by the same two steps, so nothing is gathered whole in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normscape.llm.common import saved, small_side

FAN = 3
#: Levels of a superblock: 729 leaves, some 100 KB in a group.
LEVELS = 6
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: Iterable[Column]) -> Column:
    """SHA-256 of the values one after another, each as its UTF-8 byte count, `:` and itself, or `-` if null."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def reduced(nodes: list[str], size: int) -> list[list[str]]:
    """The levels of a superblock from its nodes up; size: the nodes of the whole tree on this level.

    A tree that fits into one superblock ends at its root, one that does not goes on for LEVELS levels everywhere.
    """
    levels = [nodes]
    while len(levels[-1]) > 1 if size <= BLOCK else len(levels) <= LEVELS:
        last = levels[-1]
        levels.append([digest(*last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def sides(levels: list[list[str]], i: int) -> list[str]:
    """For each level below the top what stands left and right of node i's ancestor in its run, joined."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % FAN
        out += ["".join(nodes[first:i]), "".join(nodes[i + 1 : first + FAN])]
        i //= FAN
    return out


def folded(node: str, path: list[str]) -> str:
    """The root that a node and the sides of its path give."""
    for left, right in zip(path[::2], path[1::2]):
        node = digest(left, node, right)
    return node


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Of a saved() table with a column `group`: (tree, rank, size, ...); trees are numbered in the order of group.

    Ranks count from 0 within a group, in the given order. Rows are sorted into range partitions; a group's rows in one
    partition get their place there and the counts of the partitions before, which are a row a group and partition.
    """
    keys = ["group", *order, "__row"]  # the row tells equal keys apart, so a key of many rows is split as well
    ranged = leaves.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = saved(ranged.drop("__row").select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "numbered")
    counts = saved(rows.groupBy("__part", "group").agg(F.count("*").alias("n"), F.min("__at").alias("first")), "counts")
    whole = Window.partitionBy("group").orderBy("__part")
    placed = counts.select(
        "*",
        F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"),
    )
    starts = placed.where("base = 0")  # a row a group, where the group begins
    per_part = starts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    trees = starts.join(per_part.select("__part", F.coalesce(before, F.lit(0)).alias("__before")), "__part")
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("first"))
    trees = trees.select(F.col("group").alias("__group"), (F.col("__before") + nth - 1).cast("long").alias("tree"))
    named = placed.join(trees, F.col("group").eqNullSafe(F.col("__group"))).select(F.col("__part").alias("__p"), F.col("group").alias("__g"), "tree", "base", "size", "first")
    named = small_side(saved(named, "places"))
    joined = rows.join(named, (F.col("__part") == F.col("__p")) & F.col("group").eqNullSafe(F.col("__g")))
    return joined.withColumn("rank", F.col("base") + F.col("__at") - F.col("first")).drop("__part", "__at", "__p", "__g", "base", "first")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long"))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Levels of (tree, rank, size, node), from the given one up to that on which every tree is one node."""
    levels = [nodes]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, size = pdf.sort_values("rank"), int(pdf["size"].iloc[0])
        top = reduced(pdf["node"].tolist(), size)[-1][0]
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "rank": [pdf["block"].iloc[0]], "size": [-(-size // BLOCK)], "node": [top]})

    while True:
        up = _blocks(levels[-1]).groupBy("tree", "block").applyInPandas(one, "tree long, rank long, size long, node string")
        levels.append(saved(up, "nodes"))
        if (levels[-1].agg(F.max("size")).first()[0] or 1) == 1:
            return levels


def descended(nodes: DataFrame, outer: DataFrame, top: bool) -> DataFrame:
    """(tree, rank, subroot, path) of nodes (tree, rank, size, node); outer: the same of their superblocks, as ranks.

    top: the nodes are themselves subroots (or stand above them), else the subroot is that of the superblock.
    """

    def extend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("rank")
        levels = reduced(left["node"].tolist(), int(left["size"].iloc[0]))
        rest, subroot = list(right["path"].iloc[0]), right["subroot"].iloc[0]
        paths = [sides(levels, i) + rest for i in range(len(left))]
        return pd.DataFrame({"tree": left["tree"], "rank": left["rank"], "subroot": left["node"] if top else subroot, "path": paths})

    needed = outer.withColumnRenamed("rank", "block")
    return _blocks(nodes).groupBy("tree", "block").cogroup(needed.groupBy("tree", "block")).applyInPandas(extend, "tree long, rank long, subroot string, path array<string>")


def manifest(docs: DataFrame, fields: tuple = FIELDS, group_col: str = "source", order_col: str = "doc_id", altered: dict[str, Column] | None = None) -> DataFrame:
    """(order_col, leaf, subroot, root, proof_sha256, folded_root, verified): a row for each row of docs.

    Leaves are the fields of a row; a group's leaves ascend by order_col, null first, and equal ones by their digest (rows
    equal in all fields are interchangeable). Groups ascend too, null first, text bytewise. altered: columns in place of
    fields for the check alone: folded_root is what the altered row's leaf gives with the original siblings, and verified
    says whether that is the root. A lone leaf is its subroot, a lone subroot the root, and its proof the digest of
    nothing. Other columns are left out, so names cannot clash; an empty table gives an empty result.
    """
    given = [docs[f] for f in fields]
    forged = leaf_digest([(altered or {}).get(f, docs[f]) for f in fields])
    leaves = docs.select(docs[group_col].alias("group"), docs[order_col].alias("key"), leaf_digest(given).alias("node"), forged.alias("forged"))
    leaves = saved(leaves.withColumn("forged", F.nullif("forged", "node")), "leaves")
    rows = numbered(leaves, ["key", "node"])
    order_type = leaves.schema["key"].dataType.simpleString()
    levels = climbed(rows.select("tree", "rank", "size", "node"))
    tops = levels[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(levels[-1].count()).cast("long").alias("size"), "node")
    above = climbed(tops)
    root = above[-1].select("node").first()  # of one node
    root = root[0] if root else None
    spark = docs.sparkSession
    paths = spark.createDataFrame([(0, 0, None, [])] if root else [], "tree long, rank long, subroot string, path array<string>")
    for nodes in above[-2::-1]:
        paths = saved(descended(nodes, paths, top=True), "paths")
    paths = paths.select(F.col("rank").alias("tree"), F.lit(0).cast("long").alias("rank"), "subroot", "path")
    for nodes in levels[-2:0:-1]:
        paths = saved(descended(nodes, paths, top=False), "paths")

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("rank")
        nodes = left["node"].tolist()
        levels = reduced(nodes, int(left["size"].iloc[0]))
        rest, proofs, ends = list(right["path"].iloc[0]), [], []
        for i, forged in enumerate(left["forged"]):
            path = sides(levels, i) + rest
            proofs.append(digest(*path))
            ends.append(folded(nodes[i] if forged is None or forged != forged else forged, path))
        return pd.DataFrame({"key": left["key"], "leaf": nodes, "subroot": right["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": ends, "verified": [e == root for e in ends]})

    shown = f"key {order_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    outer = paths.withColumnRenamed("rank", "block")
    blocks = _blocks(rows.select("tree", "rank", "size", "key", "node", "forged"))
    out = blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, shown)
    return out.withColumnRenamed("key", order_col)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    return manifest(docs, altered={"text": F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])})


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in DuckDB, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {step}), 4294967295)"


#: Levels of the SQL form: up to 3 ** 12 leaves a source and 3 ** 5 sources.
_SQL_LEVELS, _SQL_TOP = 12, 5


def _sql() -> str:
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    text = f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    leaf = lambda t: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', t)))})"
    ctes = [
        f"leaves AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, {leaf('text')} AS leaf, {leaf(f'({text})')} AS forged FROM documents)",
        "d0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof, forged AS cur FROM leaves)",
        "n0 AS MATERIALIZED (SELECT t, i, leaf AS h FROM d0)",
    ]
    for k in range(_SQL_LEVELS + _SQL_TOP):
        if k == _SQL_LEVELS:  # from here on the subroots are the nodes of one tree
            ctes.append(f"n{k}t AS MATERIALIZED (SELECT 0 AS t, t AS i, h FROM n{k})")
            ctes.append(f"d{k}t AS MATERIALIZED (SELECT d.* REPLACE (0 AS t, d.t AS i), n.h AS subroot FROM d{k} d JOIN n{k} n USING (t))")
        n, d = (f"n{k}t", f"d{k}t") if k == _SQL_LEVELS else (f"n{k}", f"d{k}")
        ctes += [
            f"m{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY t) AS size, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS r FROM {n} WINDOW w AS (PARTITION BY t, i // 3 ORDER BY i))",
            f"n{k + 1} AS MATERIALIZED (SELECT t, i // 3 AS i, CASE WHEN any_value(size) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM m{k} GROUP BY t, i // 3)",
            f"d{k + 1} AS MATERIALIZED (SELECT d.* REPLACE (d.i // 3 AS i, proof || l || r AS proof, CASE WHEN size = 1 THEN cur ELSE sha256(l || cur || r) END AS cur) FROM {d} d JOIN m{k} m ON d.t = m.t AND d.i = m.i)",
        ]
    k = _SQL_LEVELS + _SQL_TOP
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM d{k} JOIN n{k} ON true"


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {"op11_merkle_manifest": _sql()}
