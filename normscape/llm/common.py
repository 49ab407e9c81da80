"""Helpers that the training-data operators share: shared-folder tables, checked broadcasts, word caches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many bytes, so that memory does not depend on the Arrow batch.
SLICE_BYTES = 1 << 20
#: Distinct words that a Python worker remembers; beyond that it forgets all and starts anew.
WORD_CACHE = 150_000
#: A side of a join is broadcast only if it takes at most this many bytes, by rows times their width.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="normscape-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch while a table is saved: whole texts make batches of the usual size tens of megabytes, of which
#: each task holds several, in the JVM and in Python.
ARROW_ROWS = 2000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: For each temporary() that is open the tables saved in it, and the names that outlive it.
_open: list[tuple[list[str], tuple[str, ...]]] = []


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs within."""
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(min(int(before), rows)))
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before)


def saved(df: DataFrame, name: str, arrow_rows: int = ARROW_ROWS) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, arrow_rows):
        df.write.parquet(path)
    if _open and name not in _open[-1][1]:
        _open[-1][0].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Deletes the tables saved() within at the end, but for those of the names to keep."""
    _open.append(([], keep))
    try:
        yield
    finally:
        for path in _open.pop()[0]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bytes_of(df: DataFrame, limit: int) -> int:
    """Bytes that a table takes in a broadcast: 64 a row, 32 a value, more for what varies in size; beyond limit a lower bound."""
    flat = (64 + 32 * len(df.columns)) * df.count()
    sizes = [48 * F.size(c) if kind.startswith("array") else F.length(c) for c, kind in df.dtypes if kind.startswith("array") or kind in ("string", "binary")]
    if flat > limit or not sizes:
        return flat
    return flat + int(df.agg(F.sum(sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(0)))).first()[0] or 0)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A saved() table marked for broadcast if its size allows it; else the planner's choice, which can spill."""
    return F.broadcast(df) if bytes_of(df, limit) <= limit else df


#: Keys that hold more than one row in so many are hot; there are at most so many of them.
HOT_SHARE = 20_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """Join a saved() row a group (key, a digest as binary; size: its rows, ..) to rows. Hot groups are broadcast, at most
    HOT_SHARE rows, and their rows dealt by what they hold, so that no task gets the rows of a hot key."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE > total
    given = [c for c in groups.columns if c != key]
    few = groups.where(hot).select(F.col(key).alias("__key"), F.struct(*given).alias("__hot"))
    own = rows.join(F.broadcast(few), rows[key] == few["__key"], "left")
    dealt = F.when(F.col("__key").isNull(), F.col(key)).otherwise(F.concat(F.col(key), F.xxhash64(*rows.columns).cast("string").cast("binary")))
    far = groups.where(~hot).select(F.col(key).alias("__far"), F.struct(*given).alias("__group"))
    out = own.withColumn("__dealt", dealt).join(far, F.col("__dealt") == F.col("__far"), "left").withColumn("__own", F.coalesce("__hot", "__group"))
    out = out if how == "left" else out.where("__own IS NOT NULL")
    return out.select(*rows.columns, *[F.col(f"__own.{c}").alias(c) for c in given])


#: Gives freed memory back to the system, where the C library has it; else it stays with the worker for good.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, body): the id as long, the text as UTF-8 bytes, null text as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[list[list]]:
    """Columns of the batches as Python lists, cut so that the last column (bytes) stays near limit a slice."""
    for b in batches:
        last = b.column(b.num_columns - 1)
        sizes = pc.binary_length(last).fill_null(0).to_numpy(zero_copy_only=False) if pa.types.is_binary(last.type) else np.ones(len(last))
        filled = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = filled[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(filled, before + limit, side="right")))
            yield [c.slice(start, end - start).to_pylist() for c in b.columns]
            start = end
    pa.default_memory_pool().release_unused()  # workers stay on between tasks
    if _trim is not None:
        _trim(0)


class Numbers(dict):
    """Word -> number; a new word takes the next one and is noted."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordCache:
    """Word -> row number, with columns computed once for each new word. Forgets everything once over cap."""

    def __init__(self, compute: Callable[[list[bytes]], tuple], cap: int = WORD_CACHE):
        self.compute, self.cap = compute, cap
        self.index = Numbers()
        self.columns: list[np.ndarray] = []

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.cap:
            self.index, self.columns = Numbers(), []
        found = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            made = self.compute(self.index.new)
            self.columns = [np.concatenate(x) for x in zip(self.columns, made)] if self.columns else list(made)
            self.index.new = []
        return found

    def look(self, words: list[bytes]) -> list[np.ndarray]:
        if not words:
            return list(self.compute([]))
        at = self.rows(words)
        return [c[at] for c in self.columns]


def hash_words(words: list[bytes]) -> tuple[np.ndarray]:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all (the splitmix64 finaliser's public constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length) one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
