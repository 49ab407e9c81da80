"""Readers and writers: labelled CSV, run JSON, lexicons, glossaries; Parquet tables partitioned by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normscape.functions.vectors import safe_float
from normscape.sources.json_parts import json_values

CONFIG = "arms array<string>"
TRAJECTORY = "traj_idx bigint, arm_idx array<int>, token_ids array<bigint>, logprobs array<double>, prefill_text string, generated_text string"


def read_labelled_csv(spark: SparkSession, path: str, text_col: int = 0, label_col: int = 1, header: bool = True) -> DataFrame:
    """(traj_idx, arm, text); rows that are short or have a blank text or label are dropped. traj_idx keeps file order."""
    raw = spark.read.csv(path, header=header, multiLine=True, escape='"', mode="PERMISSIVE")
    text, label = F.trim(F.col(f"`{raw.columns[text_col]}`")), F.trim(F.col(f"`{raw.columns[label_col]}`"))
    return raw.select(F.monotonically_increasing_id().alias("traj_idx"), label.alias("arm"), text.alias("text")).where("text <> '' AND arm <> ''")


def read_generation_json(spark: SparkSession, path: str) -> DataFrame:
    """(traj_idx, arm, token_ids, logprobs, prefill_text, generated_text); arm indexes out of range are dropped.

    One document a file; its trajectories are read in parallel, however large the file is.
    """
    trajs, config = json_values(spark, path, ("tree", "trajs"), ("config",))
    arms = config.select("file", F.from_json("value", CONFIG).getField("arms").alias("arms"))  # a row a file
    rows = trajs.select("file", F.from_json("value", TRAJECTORY).alias("t")).join(F.broadcast(arms), "file")
    arm = F.get("arms", F.col("t.arm_idx")[0])
    return rows.select("t.traj_idx", arm.alias("arm"), "t.token_ids", "t.logprobs", "t.prefill_text", "t.generated_text").where("arm IS NOT NULL")


def read_scoring_json(spark: SparkSession, path: str) -> DataFrame:
    """(traj_idx, arm, method, struct_idx, item_idx, score) of results whose method_scores hold scores or lists of them.

    One document a file, its results read in parallel; files without results are an error.
    """
    (results,) = json_values(spark, path, ("results",))
    rows = results.select(F.from_json("value", "traj_idx bigint, arm string, method_scores map<string, array<string>>").alias("r"))
    if rows.isEmpty():
        raise ValueError("no results")
    cells = rows.select("r.traj_idx", "r.arm", F.explode("r.method_scores").alias("method", "cells")).select("traj_idx", "arm", "method", F.posexplode("cells").alias("struct_idx", "cell"))
    items = F.when(F.col("cell").startswith("["), F.from_json("cell", "array<double>")).otherwise(F.array(F.col("cell").try_cast("double")))
    return cells.select("traj_idx", "arm", "method", "struct_idx", F.posexplode(items).alias("item_idx", "score"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("delta map<string, double>").json(path, multiLine=True).select(F.explode("delta").alias("word", "z"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Entries under either spelling of their fields; the type is II where none is given."""
    raw = spark.read.schema("surface_form string, term string, covert_meaning string, type string, whistle_type string, persona string, example_coded string, example_context string").json(path, multiLine=True)
    return raw.select(F.coalesce("surface_form", "term").alias("surface_form"), "covert_meaning", F.coalesce("type", "whistle_type", F.lit("II")).alias("type"), "persona", F.coalesce("example_coded", "example_context").alias("example_coded"))


def read_estimation_json(spark: SparkSession, path: str, default: float = 0.0) -> DataFrame:
    """(arm, weighting, measure, value) of a run's saved estimates: arms with weightings with numbers by name.

    Infinities and NaN come as text and are read as such; null and junk give the default.
    """
    schema = "arms array<struct<name: string, estimates: map<string, map<string, string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("arms").alias("a"))
    rows = rows.select(F.col("a.name").alias("arm"), F.explode("a.estimates").alias("weighting", "m")).select("arm", "weighting", F.explode("m").alias("measure", "x"))
    return rows.select("arm", "weighting", "measure", safe_float(F.col("x"), default).alias("value"))


def write_table(df: DataFrame, path: str, partitions: tuple = ("method", "gen", "scoring"), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*[p for p in partitions if p in df.columns]).parquet(path)


def content_id(*cols: Column) -> Column:
    """A record's id: SHA-256 of its JSON; pass doubles through rounded() so that -0.0 and noise do not matter."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def rounded(x: Column, places: int = 8) -> Column:
    return F.round(x, places) + 0.0


def merge_arm_partitions(parts: dict[str, DataFrame], arms: list[str]) -> DataFrame:
    """One table of a judge's per-arm tables; a missing arm is an error."""
    missing = [a for a in arms if a not in parts]
    if missing:
        raise ValueError(f"missing arms: {missing}")
    out = None
    for a in arms:
        out = parts[a] if out is None else out.unionByName(parts[a])
    return out
