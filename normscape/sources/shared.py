"""The folder that driver and executors share: checkpoints, scratch tables, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="normscape-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes it once the table is no longer in use.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; delete() it when it is no longer in use."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = 10_000, most: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and bytes, which a look at the first rows tells."""
    kinds = [(c, k) for c, k in df.dtypes if k in ("string", "binary") or k.startswith(("array", "map"))]
    varying = sum((F.coalesce(F.length(c) if k in ("string", "binary") else 48 * F.size(c), F.lit(0)) for c, k in kinds), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(varying)).first()
    return F.broadcast(df) if n <= rows and n * (64 + 32 * len(df.columns)) + (size or 0) <= most else df
