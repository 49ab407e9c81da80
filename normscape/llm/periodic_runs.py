"""Operator 13: periodic runs of words by longest common extensions over a harmonic grid.

A run of period q with four periods holds four neighbouring multiples of q, whose words are equal. So for each q a
document is looked at on its multiples alone (its length times the harmonic series in all), and only where four in a row
agree are the stretches to both sides measured, by difference-cover indexes of the words forwards and backwards. Each
document is worked on where it is read: there is no shuffle, and a slice of short documents is one numpy stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normscape.llm.common import batch, gather_runs, slices, text_rows
from normscape.llm.cover_lce import CoverLCE

#: Periods and words of the shortest run.
TIMES, LEAST = 4, 6
#: Grid points that are looked at together.
_POINTS = 1 << 20


def grid_hits(seq: np.ndarray, starts: np.ndarray, lengths: np.ndarray, points: int = _POINTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): grid places of documents in a stream whose next TIMES - 1 places a period apart hold the same word."""
    most = lengths // TIMES
    doc = np.repeat(np.arange(len(lengths)), most)
    period = gather_runs(np.ones(len(most), np.int64), most)  # 1, 2, ... of each document
    count = (lengths[doc] - 1) // period - (TIMES - 2)  # k with (k + TIMES - 1) * period inside
    filled = np.cumsum(count)
    begin = 0
    while begin < len(count):
        end = max(begin + 1, int(np.searchsorted(filled, (filled[begin - 1] if begin else 0) + points)))
        for at in range(0, int(count[begin:end].max()), points):  # one period alone may have more points than that
            n = np.minimum(count[begin:end] - at, points)
            n = np.maximum(n, 0)
            q = np.repeat(period[begin:end], n)
            place = np.repeat(starts[doc[begin:end]], n) + gather_runs(np.full(len(n), at), n) * q
            word = seq[place]
            for j in range(1, TIMES):
                same = np.flatnonzero(seq[place + j * q] == word)
                place, q, word = place[same], q[same], word[same]
            if len(place):
                yield place, q
        begin = end


def distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct rows, sorted."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(1))[: len(rows)]]


def stream_runs(seq: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, length, period) of all runs, in that order. seq: documents in a row, each followed by a number of its own."""
    found, indexes, known = [], None, np.zeros((0, 3), np.int64)
    for place, q in grid_hits(seq, starts, lengths):
        if len(known):  # inside a run whose period divides q the stretch is that run
            near = known[np.maximum(np.searchsorted(known[:, 0], place, side="right") - 1, 0)]
            new = (near[:, 0] > place) | (near[:, 0] + near[:, 1] <= place + (TIMES - 1) * q) | (q % near[:, 2] > 0)
            place, q = place[new], q[new]
        if not len(place):
            continue
        if indexes is None:
            indexes = CoverLCE(seq), CoverLCE(seq[::-1].copy())
        after = indexes[0].lce(place, place + q)
        before = indexes[1].lce(len(seq) - place, len(seq) - place - q)
        length = before + q + after
        whole = length >= np.maximum(LEAST, TIMES * q)
        found.append(distinct(np.stack([(place - before)[whole], length[whole], q[whole]], 1)))
        known = found[-1] if not len(known) else known
    if not found:
        return (np.zeros(0, np.int64),) * 4
    runs = distinct(np.concatenate(found))
    # the same stretch under a multiple of its period
    first = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))[: len(runs)]
    start, length, period = runs[first].T
    doc = np.searchsorted(starts, start, side="right") - 1
    order = np.lexsort((period, start))
    return doc[order], start[order] - starts[doc[order]], length[order], period[order]


def slice_runs(words: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """stream_runs() of documents given as words. Indexes are built over documents with a grid hit alone."""
    lengths = np.array([len(w) for w in words], np.int64)
    ids = pa.array([w for x in words for w in x], pa.large_binary()).dictionary_encode()
    seq = np.empty(int(lengths.sum()) + len(words), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(seq), bool)
    inside[ends] = False
    seq[inside] = ids.indices.to_numpy()
    seq[ends] = len(ids.dictionary) + np.arange(len(words))
    starts = ends - lengths
    some = np.unique(np.concatenate([np.searchsorted(starts, p, side="right") - 1 for p, _ in grid_hits(seq, starts, lengths)] or [np.zeros(0, np.int64)]))
    own = gather_runs(starts[some], lengths[some] + 1)
    doc, *rest = stream_runs(seq[own], np.cumsum(lengths[some] + 1) - lengths[some] - 1, lengths[some])
    return some[doc], *rest


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, n_dropped, collapsed_sha256[, collapsed]) for each row of docs.

    runs: array of (start, length, period) by start, then period: stretches of words with smallest period q and a length
    of at least LEAST and TIMES * q that no neighbouring word extends. Words of a run after its first q are dropped from
    collapsed, the other words joined by one space; collapsed_sha256 is its digest. Null and blank texts have no words and
    no runs. Repeated rows each get their row; other columns are left out, so names cannot clash; an empty table gives an
    empty result. A text is worked on whole, in memory of some hundred bytes a word.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("n_dropped", pa.int64()), ("collapsed_sha256", pa.string())]
    schema = pa.schema(fields + [("collapsed", pa.string())] * with_text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in slices(batches):
            words = [b.split() for b in bodies]
            doc, *columns = slice_runs(words)
            dropped = [0] * len(words)
            edges = np.searchsorted(doc, np.arange(len(words) + 1))
            kept = list(words)
            for d in np.unique(doc):
                own = slice(edges[d], edges[d + 1])
                start, length, period = (c[own] for c in columns)
                marks = np.zeros(len(words[d]) + 1, np.int64)
                np.add.at(marks, start + period, 1)
                np.add.at(marks, start + length, -1)
                keep = np.cumsum(marks[:-1]) == 0
                kept[d] = [words[d][i] for i in np.flatnonzero(keep)]
                dropped[d] = len(keep) - len(kept[d])
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(run)))
            texts = [b" ".join(k) for k in kept]
            out = [ids, [len(w) for w in words], runs, dropped, [hashlib.sha256(t).hexdigest() for t in texts]]
            yield batch(schema, *out, *[[t.decode("utf-8", "replace") for t in texts]] * with_text)

    ddl = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, n_dropped long, collapsed_sha256 string" + ", collapsed string" * with_text
    return text_rows(docs, id_col, text_col).mapInArrow(find, ddl)


def planted(id_col: Column, text_col: Column) -> Column:
    """The text with words from place a on repeated with period p, for every id whose crc32 ends in 0 (the stated rule)."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))

    # a lambda's variable stands for the words, so that they are split once
    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")))[0]
    return F.when((h % 10 == 0) & text_col.isNotNull(), F.coalesce(text, text_col)).otherwise(text_col)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = periodic_runs(docs.select("doc_id", planted(docs["doc_id"], docs["text"]).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = rows.withColumn("__best", best)
    length, period = F.col("__best.length"), -F.col("__best.p")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
