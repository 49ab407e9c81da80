"""The corpus pipeline: language ID, exact dedup, near-dedup, secret redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normscape.llm import exact_dedup, language_id, near_dedup, packing, secrets
from normscape.llm.common import saved, small_side

#: Rejected as no language: no letter at all, or a posterior this close to a blind guess.
MIN_LANGUAGE_SCORE = 0.3
#: Words whose ids a Python worker keeps from stage to stage: fewer than packing alone would, for memory.
WORDS_KEPT = 50_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text has a recognisable language; `lang` stays what it was. Null and empty texts go."""
    return saved(language_id.recognised(docs, language_id.train(docs), MIN_LANGUAGE_SCORE), "recognised")  # in small batches


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays (a null id only if there is no other); its repeated rows all stay.

    Rows are kept by id and text, so another text under the same id does not bring a duplicate back.
    """
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.xxhash64("text_sha256").alias("__text")).distinct()
    own = F.xxhash64(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    wanted = small_side(saved(kept, "kept"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__id"]) & (own == wanted["__text"]), "left_semi").select(*[docs[c] for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest doc_id: five-word shingles, a similarity of 0.8 or more.

    Rows with a null id link with nothing and stay.
    """
    kept = near_dedup.near_duplicates(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    wanted = small_side(saved(kept, "kept"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__id"]), "left_semi").select(*[docs[c] for c in docs.columns])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; confirmed secrets are masked and n_chars follows the new text."""
    columns = docs.columns
    clean = secrets.redact(docs, secrets.scan(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast("long")).select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    pieces = packing.token_pieces(docs, packing.tokenizer_path(), words_kept=WORDS_KEPT)
    return packing.pack(saved(pieces, "pieces"))


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The language model, the forest and the tokenizer are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
