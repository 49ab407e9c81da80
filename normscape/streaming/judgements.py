"""Structured Streaming over judgements (sample_id, node_id, q_idx, score, ts); a null score counts as 0 and an error.

Every operator counts a repeated judgement once and has state that ends: by the watermark, or by timers of event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from normscape.operators.dynamics import moments
from normscape.sources.shared import delete, scratch

JUDGEMENTS = "sample_id long, node_id int, q_idx int, score double, ts timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Event time for which the state of a key is kept after the last row of it.
KEEP_MS = 3_600_000
#: Buckets of samples: what a task holds of a batch is the rows of one.
BUCKETS = 4096


def _once(judgements: DataFrame, delay: str, key: tuple = ("sample_id", "q_idx")) -> DataFrame:
    return judgements.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key))


def _score():
    return F.coalesce("score", F.lit(0.0))


def stream_cores(judgements: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Live core: (node_id, q_idx, mean, std, n, errors), for update mode."""
    return _once(judgements, delay).groupBy("node_id", "q_idx").agg(F.avg(_score()).alias("mean"), F.stddev_pop(_score()).alias("std"), F.count("*").alias("n"), F.sum(F.col("score").isNull().cast("long")).alias("errors"))


def windowed_cores(judgements: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(window, node_id, q_idx, mean, n), each window once, for append mode: when the watermark has passed its end.

    A judgement that comes again within the delay counts once; rows later than the watermark are dropped.
    """
    return _once(judgements, delay).groupBy(F.window("ts", width), "node_id", "q_idx").agg(F.avg(_score()).alias("mean"), F.count("*").alias("n"))


def complete_counts(judgements: DataFrame, n_questions: int, delay: str = "10 minutes") -> DataFrame:
    """Samples whose questions are all in, by an aggregate in update mode."""
    return _once(judgements, delay).groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") == n_questions)


class _Timed(StatefulProcessor):
    """State of a key that a timer of event time clears, keep_ms after the newest row or the watermark."""

    keep_ms = KEEP_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wait(self, newest: int, watermark: int) -> None:
        due = max(newest, watermark, 0) + self.keep_ms
        before = list(self.handle.listTimers())
        if all(t < due for t in before):
            for t in before:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)


class _Complete(StatefulProcessor):
    """Emits a sample once all its questions are in. A key is a bucket of samples, so that rows come many at a time.

    State of a sample is a value of at most n_questions scores, which go once it is emitted. A bucket has one timer: when it
    is due, what is then over goes, and the next is due with the first of the rest, a quarter of keep_ms later at least.
    """

    def __init__(self, n_questions: int, keep_ms: int):
        self.n_questions, self.keep_ms = n_questions, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getMapState("samples", "sample_id long, absent boolean", "due long, done boolean, questions array<int>, scores array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = max(timerValues.getCurrentWatermarkInMs(), 0)
        came, out, first = pd.concat(list(rows), ignore_index=True), [], None
        known, names = self.samples.exists(), ["row_sample", "row_absent"]
        newest = came.groupby(names)["row_ms"].max().to_dict()
        scores: dict[tuple, dict[int, float]] = {}  # within a batch the last score of a question counts
        for s, absent, q, x in zip(came["row_sample"], came["row_absent"], came["q_idx"], came["score"]):
            scores.setdefault((s, absent), {})[int(q)] = 0.0 if pd.isna(x) else float(x)
        for name, own in scores.items():
            at, ms = (int(name[0]), bool(name[1])), newest[name]
            due = max(0 if pd.isna(ms) else int(ms), watermark) + self.keep_ms
            before = self.samples.getValue(at) if known else None
            if before is not None and before[0] > watermark:
                if before[1] and before[0] >= due:
                    continue
                due, own = max(due, before[0]), dict(zip(before[2], before[3])) | own
            else:
                before = None
            emitted = before is not None and before[1]
            done = emitted or len(own) == self.n_questions
            self.samples.updateValue(at, (due, done, [] if done else list(own), [] if done else list(own.values())))
            first = due if first is None else min(first, due)
            if done and not emitted:
                out.append((None if at[1] else at[0], sum(own[q] for q in sorted(own)) / len(own)))
        if first is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(first)
        if out:
            yield pd.DataFrame({"sample_id": pd.array([x[0] for x in out], "Int64"), "mean": [x[1] for x in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, over, rest = timerValues.getCurrentWatermarkInMs(), [], {}
        for at, value in self.samples.iterator():
            if value[0] > watermark:
                rest[tuple(at)] = tuple(value)
            else:
                over.append(tuple(at))
        if len(over) > len(rest):
            self.samples.clear()
            for at, value in rest.items():
                self.samples.updateValue(at, value)
        else:
            for at in over:
                self.samples.removeKey(at)
        if rest:
            self.handle.registerTimer(max(min(v[0] for v in rest.values()), watermark + self.keep_ms // 4 + 1))
        return iter(())

    def close(self) -> None:
        pass


class _Means(_Timed):
    """Emits the mean of a key's members, the newest score of each, whenever one comes or changes."""

    def __init__(self, names: list[str], null: float | None, keep_ms: int):
        self.names, self.null, self.keep_ms = names, null, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.members = handle.getMapState("members", "member string", "ms long, score double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}  # of a member the newest score of the batch; of equally new ones the largest, null last
        for pdf in rows:
            for m, ms, s in zip(pdf["row_member"], pdf["row_ms"], pdf["score"]):
                new = (int(ms), not pd.isna(s), 0.0 if pd.isna(s) else float(s))
                best[m] = max(best.get(m, new), new)
        before = {k[0]: (v[0], v[1] is not None and not pd.isna(v[1]), v[1]) for k, v in self.members.iterator()}
        changed = {m: x for m, x in best.items() if m not in before or x[:2] > before[m][:2] or x[:2] == before[m][:2] and x[1] and x[2] > before[m][2]}
        for m, (ms, there, s) in changed.items():
            self.members.updateValue((m,), (ms, s if there else None))
        self.wait(max((x[0] for x in best.values()), default=0), timerValues.getCurrentWatermarkInMs())
        if changed:
            scores = [x[2] if x[1] else self.null for x in (before | changed).values()]
            known = [x for x in scores if x is not None]
            out = {n: [k] for n, k in zip(self.names, key)}
            yield pd.DataFrame(out | {"mean": [sum(known) / len(known) if known else None], "n": [len(scores)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.members.clear()
        return iter(())

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withWatermark("ts", delay).withColumn("row_ms", F.unix_millis("ts"))


def stream_complete_samples(judgements: DataFrame, n_questions: int, delay: str = "10 minutes", keep_ms: int = KEEP_MS, buckets: int = BUCKETS) -> DataFrame:
    """(sample_id, mean), once, for append mode: when all questions of a sample are in; the last score of a question counts.

    Samples are dealt into buckets, whose rows of a batch are held together. A sample costs a read and a write of its state
    in a batch that has rows of it. Its scores go as it is emitted; what says that it was, and what stays incomplete, counts
    until the watermark is keep_ms past the sample's newest row. Needs the RocksDB state store.
    """
    absent = F.col("sample_id").isNull()
    rows = _timed(judgements, delay).select("ts", "q_idx", "score", "row_ms", F.coalesce("sample_id", F.lit(0)).cast("long").alias("row_sample"), absent.alias("row_absent"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row_sample"), F.lit(buckets))).groupBy("bucket")
    return dealt.transformWithStateInPandas(_Complete(n_questions, keep_ms), "sample_id long, mean double", "append", "eventTime")


def _stream_means(rows: DataFrame, keys: list[str], member: str, null: float | None, delay: str, keep_ms: int) -> DataFrame:
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    name = F.col(member).cast("string") if member in rows.columns else F.col("ts").cast("string")
    timed = _timed(rows, delay).select(*keys, "score", "ts", "row_ms", F.coalesce(name, F.lit("")).alias("row_member"))
    return timed.groupBy(*keys).transformWithStateInPandas(_Means(keys, null, keep_ms), f"{kinds}, mean double, n long", "update", "eventTime")


def stream_judge_average(responses: DataFrame, delay: str = "10 minutes", keep_ms: int = KEEP_MS, judge: str = "judge") -> DataFrame:
    """(text, question, score, n) over judges, for update mode; nulls count as judges without a score, all null stays null.

    Of a judge that answers again the newest counts, and a repeated answer changes nothing. A pair's state ends by a
    timer, keep_ms after its newest answer.
    """
    return _stream_means(responses, ["text", "question"], judge, None, delay, keep_ms).withColumnRenamed("mean", "score")


def stream_positions(scores: DataFrame, delay: str = "10 minutes", keep_ms: int = KEEP_MS, member: str = "sample_id") -> DataFrame:
    """(traj_idx, k, struct_idx, mean, n) of prefix scores (traj_idx, k, struct_idx, score, ts), for update mode.

    member names what tells the scores of a position apart, ts where there is no such column: a score that comes again
    counts once, and of two of one member the newest. Null counts as 0. State ends as in stream_judge_average.
    """
    return _stream_means(scores, ["traj_idx", "k", "struct_idx"], member, 0.0, delay, keep_ms)


def latest(stream: DataFrame, keys: list[str], name: str, mode: str = "update") -> DataFrame:
    """What a stream over what there is gives in the end: a row a key, of the last batch that has one. Runs it now.

    Its batches are written to the shared folder; state is kept in RocksDB, which timers and map state need.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)
    write = lambda batch, i: batch.withColumn("__batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/batch={i}")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    delete(spark, f"{path}-state")
    given = [c for c in stream.columns if c not in keys]
    rows = spark.read.option("basePath", path).schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", __batch long").parquet(f"{path}/batch=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*given), "__batch").alias("x")).select(*keys, *[f"x.{c}" for c in given])


def positions_in_order(table: DataFrame, total: int) -> DataFrame:
    """(traj_idx, k, system, progress): what stream_positions() has so far, in order; progress: positions in of total.

    A position updated several times counts with its largest n; a trajectory's positions are few.
    """
    last = table.groupBy("traj_idx", "k", "struct_idx").agg(F.max_by("mean", "n").alias("mean"))
    rows = last.groupBy("traj_idx", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("struct_idx", "mean"))), lambda x: x["mean"]).alias("system"))
    done = F.count("*").over(Window.partitionBy("traj_idx")) / F.lit(float(total))
    return rows.withColumn("progress", done).orderBy("traj_idx", "k")


#: Tables of a level that are merged into one of the next.
LEVEL = 8


class BatchTable:
    """A table that grows by batches: each appends its own rows, and LEVEL tables of a level are merged into one above.

    So a batch costs what it brings, and a share of merges that grows with the logarithm of the batches; readers merge a
    few tables. A table is named by its level and its first and last batch. One that is complete replaces those that it
    covers, which are then deleted; a batch that comes again, after a failure, is written again or, once merged, skipped.
    """

    def __init__(self, path: str, merge: Callable[[DataFrame], DataFrame], level: int = LEVEL):
        self.path, self.merge, self.level = path.rstrip("/"), merge, level

    def tables(self, spark: SparkSession) -> list[tuple[int, int, int]]:
        """(level, first, last) of the complete tables that none covers, by batch."""
        names = [n for n in _listing(spark, self.path) if n.startswith("level-")]
        own = [tuple(map(int, n.split("-")[1:])) for n in names if "_SUCCESS" in _listing(spark, f"{self.path}/{n}")]
        return sorted((x for x in own if not any(y[0] > x[0] and y[1] <= x[1] and x[2] <= y[2] for y in own)), key=lambda x: x[1])

    def _at(self, table: tuple[int, int, int]) -> str:
        return f"{self.path}/level-" + "-".join(map(str, table))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if any(level and first <= batch_id <= last for level, first, last in self.tables(spark)):
            return
        self.merge(rows).write.mode("overwrite").parquet(self._at((0, batch_id, batch_id)))
        level = 0
        while len(full := [t for t in self.tables(spark) if t[0] == level]) >= self.level:
            above = (level + 1, full[0][1], full[-1][2])
            self.merge(spark.read.parquet(*map(self._at, full))).write.mode("overwrite").parquet(self._at(above))
            for t in full:
                delete(spark, self._at(t))
            level += 1

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The merged rows of all batches; upto: of those up to this one, if none of them is merged with a later one."""
        tables = [t for t in self.tables(spark) if upto is None or t[1] <= upto]
        if not tables:
            raise ValueError(f"no batch in {self.path}")
        if upto is not None and tables[-1][2] > upto:
            raise ValueError(f"batch {upto} is merged with later ones")
        return self.merge(spark.read.parquet(*map(self._at, tables)))


def _sum_moments(rows: DataFrame) -> DataFrame:
    """Moments (n, mean, m2) a node of several; those of a node are merged around their mean."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    whole = rows.groupBy("node_id").agg(n.alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"))
    off = rows.join(whole.select("node_id", F.col("mean").alias("__mean")), "node_id")
    spread = off.groupBy("node_id").agg(F.sum(F.coalesce("m2", F.lit(0.0)) + F.col("n") * F.pow(F.col("mean") - F.col("__mean"), F.lit(2))).alias("m2"))
    return whole.join(spread, "node_id")


def running_table(path: str) -> BatchTable:
    """(node_id, n, mean, m2) of merge_running()."""
    return BatchTable(path, _sum_moments)


def progress_table(path: str) -> BatchTable:
    """(node_id, n, errors) of merge_progress()."""
    return BatchTable(path, lambda rows: rows.groupBy("node_id").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors")))


def merge_running(judgements: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch body: add a batch's moments per node to the running_table() at path."""
    running_table(path).add(moments(judgements.select("node_id", _score().alias("x")), ["node_id"]), batch_id)


def merge_progress(judgements: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch body: add a batch's scores and errors per node to the progress_table() at path."""
    counts = judgements.groupBy("node_id").agg(F.count("*").alias("n"), F.sum(F.col("score").isNull().cast("long")).alias("errors"))
    progress_table(path).add(counts, batch_id)


def progress(counts: DataFrame, max_rounds: int) -> DataFrame:
    """(samples, min_samples, errors, finished) of a progress_table(): finished once each node has max_rounds."""
    return counts.agg(F.sum("n").alias("samples"), F.min("n").alias("min_samples"), F.sum("errors").alias("errors")).withColumn("finished", F.coalesce(F.col("min_samples") >= max_rounds, F.lit(False)))


def _listing(spark, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
