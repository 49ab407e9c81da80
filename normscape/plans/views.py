"""Views over the base tables: the engine's inputs, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normscape.functions.text import word_count

_ARM_DOCS = """CASE WHEN lang = 'en' AND doc_id % 4 = 0 THEN 'root' WHEN lang = 'en' THEN 'trunk'
 WHEN lang = 'de' AND doc_id % 2 = 1 THEN 'twig_b1_1' WHEN lang = 'de' THEN 'branch_1'
 WHEN lang = 'fr' AND doc_id % 2 = 1 THEN 'twig_b2_1' WHEN lang = 'fr' THEN 'branch_2' ELSE 'branch_3' END"""
_ARM_LI = """CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'root' WHEN 'AO' THEN 'trunk' WHEN 'NF' THEN 'branch_1'
 WHEN 'NO' THEN 'branch_2' WHEN 'RF' THEN 'twig_b1_1' ELSE 'twig_b2_1' END"""
PHRASES = ["the", "and", "de", "of the"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traj_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_idx, arm, text, n_tokens, logprob)"""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("traj_idx"), F.expr(_ARM_DOCS).alias("arm"), "text", word_count(F.col("text")).alias("n_tokens"))
    return rows.withColumn("logprob", F.expr("-0.05D * n_tokens - (traj_idx % 17) / 4.0D"))


def systems_li(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(traj_idx, arm, system, logprob, n_tokens) of the lines asked for: traj_idx is made of the line's keys and is nearly unique."""
    system = "array(l_discount * 10D, l_tax / 0.08D, l_quantity / 50D, CAST(month(l_shipdate) % 2 AS DOUBLE))"
    key = "((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey"
    return table(spark, sf_dir, "lineitem").where(where).selectExpr(f"{key} AS traj_idx", f"{_ARM_LI} AS arm", f"{system} AS system", "-l_extendedprice / 10000D AS logprob", "CAST(l_quantity AS INT) AS n_tokens")


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(judge, traj_idx, arm, struct_idx, item_idx, score, ts)"""
    score = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE least(value / 330D, 1D) END"
    return table(spark, sf_dir, "events").selectExpr("event_type AS judge", "user_id AS traj_idx", "CASE WHEN user_id % 2 = 0 THEN 'trunk' ELSE 'branch_1' END AS arm", "CAST(event_id % 3 AS INT) AS struct_idx", "CAST(event_id % 2 AS INT) AS item_idx", f"{score} AS score", "ts")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = """CASE event_id % 12 WHEN 0 THEN 'ANSWER: 1' WHEN 1 THEN '0.85' WHEN 2 THEN '7/10' WHEN 3 THEN '<think>x</think> yes' WHEN 4 THEN '80%'
      WHEN 5 THEN '**no**' WHEN 6 THEN 'n/a' WHEN 7 THEN '<answer>0.3</answer>' WHEN 8 THEN 'ANSWER: NO' WHEN 9 THEN '.5' WHEN 10 THEN '' ELSE 'SCORE: 8' END"""
    return table(spark, sf_dir, "events").selectExpr("event_type AS judge", "event_id", "event_id % 12 AS question", f"{raw} AS raw")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def token_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_idx, arm, tokens): all words of each document."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return traj_docs(spark, sf_dir).select("traj_idx", "arm", words.alias("tokens"))


def labelled(spark: SparkSession, sf_dir: str, toxic: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(table(spark, sf_dir, "labels").where(F.col("toxic") == toxic).select("doc_id"), "doc_id", "left_semi")


DOCS = f"""docs AS (SELECT traj_idx, arm, text, n_tokens, -0.05::DOUBLE * n_tokens - (traj_idx % 17) / 4.0::DOUBLE AS logprob FROM
 (SELECT doc_id AS traj_idx, {_ARM_DOCS} AS arm, text, len(regexp_extract_all(text, '\\S+'))::INT AS n_tokens FROM documents))"""
SYS = f"""sys AS (SELECT ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey AS traj_idx, {_ARM_LI} AS arm,
 l_discount * 10 AS s0, l_tax / 0.08::DOUBLE AS s1, l_quantity / 50 AS s2, (month(l_shipdate) % 2)::DOUBLE AS s3,
 -l_extendedprice / 10000 AS logprob, l_quantity::INT AS n_tokens FROM lineitem)"""
#: weights of systems_li: name -> DuckDB expression over the arm's rows
WEIGHTS = {
    "prob": "exp(logprob - max(logprob) OVER (PARTITION BY arm))",
    "inv-ppl": "CASE WHEN n_tokens > 0 AND logprob > -700 THEN exp(logprob / n_tokens) ELSE 0 END",
    "log-prob": "logprob",
    "log-inv-ppl": "CASE WHEN n_tokens > 0 THEN logprob / n_tokens ELSE logprob END",
    "uniform": "1::DOUBLE",
}


def weighted(method: str = "inv-ppl") -> str:
    """CTEs sys, raw, wt: systems with a weight w that sums to 1 in each arm."""
    return f"{SYS}, raw AS (SELECT *, {WEIGHTS[method]} AS u FROM sys), wt AS (SELECT *, u / sum(u) OVER (PARTITION BY arm) AS w FROM raw)"


def long(source: str, keep: str) -> str:
    """A CTE lng(keep.., struct_idx, x) of a CTE with s0..s3."""
    parts = " UNION ALL ".join(f"SELECT {keep}, {i} AS struct_idx, s{i} AS x FROM {source}" for i in range(4))
    return f"lng AS ({parts})"


JUDGES = """js AS (SELECT event_type AS judge, user_id AS traj_idx, CASE WHEN user_id % 2 = 0 THEN 'trunk' ELSE 'branch_1' END AS arm,
 (event_id % 3)::INT AS struct_idx, (event_id % 2)::INT AS item_idx, CASE WHEN event_id % 13 = 0 THEN NULL ELSE least(value / 330, 1) END AS score, ts FROM events)"""
#: Word sequences in order, each with the words it shares with the one before: a prefix is a run of rows. CTEs tok,
#: s (k, traj_idx, tokens, n, lcp) and node (pos, lo, hi): runs whose rows go on differently, none of them ended.
SEQS = f"""{DOCS}, tok AS (SELECT traj_idx, arm, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS tokens FROM docs WHERE text IS NOT NULL),
 o AS (SELECT traj_idx, tokens, len(tokens) AS n, row_number() OVER (ORDER BY tokens, traj_idx) AS k FROM tok),
 z AS (SELECT b.k, b.traj_idx, b.tokens, b.n, a.tokens AS before, least(a.n, b.n) AS m FROM o b LEFT JOIN o a ON a.k = b.k - 1),
 s AS (SELECT k, traj_idx, tokens, n, CASE WHEN before IS NULL THEN -1 ELSE coalesce(list_position(list_transform(list_zip(tokens[1:m], before[1:m]), lambda x: x[1] = x[2]), false) - 1, m) END AS lcp FROM z),
 part AS (SELECT DISTINCT x.lcp AS pos, coalesce((SELECT max(y.k) FROM s y WHERE y.k < x.k AND y.lcp < x.lcp), 1) AS lo,
  coalesce((SELECT min(y.k) - 1 FROM s y WHERE y.k > x.k AND y.lcp < x.lcp), (SELECT max(k) FROM s)) AS hi FROM s x WHERE x.lcp >= 0),
 ended AS (SELECT k, n, coalesce((SELECT min(y.k) - 1 FROM s y WHERE y.k > x.k AND y.lcp < x.n), (SELECT max(k) FROM s)) AS until FROM s x),
 node AS (SELECT pos, lo, hi FROM part WHERE NOT EXISTS (SELECT 1 FROM ended e WHERE e.n <= pos AND e.k <= hi AND e.until >= lo))"""
