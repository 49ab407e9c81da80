"""Operator 8: substring dedup with compressed FM-indexes.

1. Each document's minimizers (the smallest hash of ANCHOR words in each window) name its windows: a window of
   `window` words has one anchor, the same wherever the window occurs. Whole copies are set aside by digest.
2. Only anchors that occur in several documents go on. Each of their occurrences owns a run of windows; its words, a
   sequence of at most 75, are sent once a task, under the anchor, with the smallest document that has it.
   Those of an anchor with over HOT different sequences (a common line in many contexts) are dealt over several shards.
3. Groups of anchors, or parts of them, make shards. A shard builds a compressed FM-index over its sequences and streams them through:
   backward search over the wavelet matrix gives matching statistics, and where they reach the window's length, the
   smallest document of the matching suffixes. Of anchors in several shards the least of the shards' answers counts,
   by the hash of each window.
4. Windows that start in a smaller document are joined back to all occurrences, and each document's covered words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normscape.llm.common import WordCache, batch, hash_words, join_groups, mix, saved, slices, small_side, temporary, text_rows
from normscape.llm.fm_index import FMIndex

WINDOW = 50
SHARD_WORDS = 150_000
HOT = 512
_SENT_BYTES = 16 << 20
_NO_OWNER = (1 << 63) - 1


def gram_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each position on, by doubling; the last length - 1 positions are left out."""
    out, done, power, width = None, 0, h, 1
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while done < length:
        if length & width:
            part = power[done : done + n]
            out = part if out is None else mix(out * np.uint64(5) + part)
            done += width
        if done < length:
            power = mix(power[: len(power) - width] * np.uint64(3) + power[width:]) if len(power) > width else power[:0]
            width *= 2
    return out


def anchor_runs(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, number of windows) of each run of windows with the same anchor."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    g = gram_hashes(h, anchor)
    bits = np.uint64(max(24, len(g).bit_length()))
    key = ((g >> bits) << bits) | np.arange(len(g), dtype=np.uint64)
    span, width, least = window - anchor + 1, 1, key
    while 2 * width <= span:
        least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
    least = np.minimum(least[:n], least[span - width : span - width + n])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return g[at[first]], first, np.diff(np.append(first, n))


def _profile(docs: DataFrame, window: int, anchor: int, with_text: bool) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("digest", pa.binary()), ("sha", pa.string()), ("anchors", pa.list_(pa.int64()))] + [("plain", pa.string())] * with_text)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache(hash_words)
        for ids, texts in slices(batches):
            split = [t.split() for t in texts]
            (hashes,) = words.look([w for s in split for w in s])
            digests, shas, anchors, at = [], [], [], 0
            plain = [b" ".join(s) for s in split]
            for s, t in zip(split, plain):
                h = hashes[at : at + len(s)]
                at += len(s)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                shas.append(hashlib.sha256(t).hexdigest())
                anchors.append(np.unique(anchor_runs(h, window, anchor)[0]).astype(np.int64))
            yield batch(schema, ids, [len(s) for s in split], digests, shas, anchors, *[[t.decode("utf-8", "replace") for t in plain]] * with_text)

    return docs.mapInArrow(profile, "doc_id long, n_words long, digest binary, sha string, anchors array<long>" + ", plain string" * with_text)


def _occurrences(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """From (doc_id, digest, anchors, body): rows of occurrences (words null) and of sequences (words set).

    A sequence row's doc_id is the smallest of its task's documents so far.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("anchor", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("words", pa.binary())])

    def emit(sent: dict) -> pa.RecordBatch:
        rows = [(d, None, a, q, None, n, w) for (a, q), (d, n, w) in sent.items()]
        return batch(schema, *zip(*rows))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sent, size = WordCache(hash_words), {}, 0
        for ids, digests, wanted, texts in slices(batches):
            split = [t.split() for t in texts]
            (hashes,) = words.look([w for s in split for w in s])
            out, at = [], 0
            for i, digest, want, s in zip(ids, digests, wanted, split):
                h = hashes[at : at + len(s)]
                at += len(s)
                if xxhash.xxh3_128_digest(h.tobytes()) != digest:
                    continue  # another row that repeats the id
                g, first, count = anchor_runs(h, window, anchor)
                for k in np.flatnonzero(np.isin(g, np.array(want, np.int64).astype(np.uint64))):
                    a, n = int(first[k]), int(count[k])
                    body = h[a : a + n + window - 1].tobytes()
                    key = (int(g[k].astype(np.int64)), xxhash.xxh3_64_intdigest(body) - (1 << 63))
                    out.append((i, digest, *key, a, n, None))
                    if key not in sent:
                        size += len(body)
                        sent[key] = (i, n, body)
                    elif i < sent[key][0]:
                        sent[key] = (i, n, body)
            if out:
                yield batch(schema, *zip(*out))
            if size > _SENT_BYTES:
                yield emit(sent)
                sent, size = {}, 0
        if sent:
            yield emit(sent)

    return docs.mapInArrow(extract, "doc_id long, digest binary, anchor long, seq long, start long, windows long, words binary")


def shard_owners(sequences: list[np.ndarray], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each sequence (word hashes) the smallest owner of a sequence of the shard that has it."""
    lengths = np.array([len(s) for s in sequences])
    alphabet, symbols = np.unique(np.concatenate(sequences), return_inverse=True)
    symbols = symbols + 1
    ends = np.cumsum(lengths)
    text = np.insert(symbols, ends, 0)
    index = FMIndex(text, len(alphabet) + 1, window)
    of = np.repeat(owners, lengths + 1)[index.suffixes]
    least = np.minimum.reduceat(of, index.class_start)
    lanes = np.full((len(sequences), lengths.max()), -1, np.int64)
    lanes[np.arange(lengths.max()) < lengths[:, None]] = symbols
    _, found = index.statistics(lanes)
    return [least[found[r, : n - window + 1]] for r, n in enumerate(lengths)]


def _matched(sequences: DataFrame, window: int, shard_words: int, with_windows: bool = False) -> DataFrame:
    """(route, anchor, seq, doc_id, words) -> (anchor, seq, owners[, windows]): the smallest document of each window of
    each sequence among the sequences of its route; windows: the windows' hashes."""
    fields = [("anchor", pa.int64()), ("seq", pa.int64()), ("owners", pa.list_(pa.int64()))]
    schema = pa.schema(fields + [("windows", pa.list_(pa.int64()))] * with_windows)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[list] = []
        size = 0

        def close() -> pa.RecordBatch:
            words = [np.frombuffer(s[4], np.uint64) for s in shard]
            found = shard_owners(words, np.array([s[3] for s in shard], np.int64), window)
            more = [[gram_hashes(w, window).astype(np.int64) for w in words]] if with_windows else []
            return batch(schema, [s[1] for s in shard], [s[2] for s in shard], found, *more)

        for columns in slices(batches):
            for row in zip(*columns):
                if shard and shard[-1][0] == row[0] and shard[-1][2] == row[2]:
                    shard[-1][3] = min(shard[-1][3], row[3])
                    continue
                if size >= shard_words and shard[-1][0] != row[0]:
                    yield close()
                    shard, size = [], 0
                shard.append(list(row))
                size += len(row[4]) // 8
        if shard:
            yield close()

    dealt = sequences.select("route", "anchor", "seq", "doc_id", "words").repartition("route").sortWithinPartitions("route", "seq")
    return dealt.mapInArrow(match, "anchor long, seq long, owners array<long>" + ", windows array<long>" * with_windows)


def _matched_hot(sequences: DataFrame, window: int, hot: int, shard_words: int) -> DataFrame:
    """_matched() of (anchor, n, seq, doc_id, words), where n sequences share the anchor: a route has about `hot` of them."""
    route = F.xxhash64("anchor", F.pmod("seq", F.ceil(F.col("n") / hot)))
    found = saved(_matched(sequences.withColumn("route", route), window, shard_words, with_windows=True), "hot")
    pairs = F.arrays_zip(F.col("windows").alias("w"), F.col("owners").alias("o"))
    each = found.select("anchor", "seq", F.posexplode(pairs).alias("at", "x")).select("anchor", "seq", "at", F.col("x.w").alias("w"), F.col("x.o").alias("o"))
    least = each.groupBy("w").agg(F.min("o").alias("owner"), F.max("o").alias("most")).where("owner < most").drop("most")
    back = each.join(least, "w", "left").groupBy("anchor", "seq").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("owner", "o").alias("o")))).alias("x"))
    return back.select("anchor", "seq", F.transform("x", lambda x: x["o"]).alias("owners"))


def repeated_windows(docs: DataFrame, profile: DataFrame, window: int, anchor: int, hot: int, shard_words: int) -> DataFrame:
    """(doc_id, digest, starts): the windows of each document that also start in one with a smaller id.

    Of equal word sequences only the smallest document is looked at; the others are copies as a whole.
    """
    owners = profile.where(F.col("doc_id").isNotNull() & (F.size("anchors") > 0)).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    own = profile.join(owners, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    anchors = saved(own.select("doc_id", "digest", F.explode("anchors").alias("anchor")), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    wanted = anchors.join(shared, "anchor").groupBy("doc_id", "digest").agg(F.collect_list("anchor").alias("anchors"))
    texts = docs.join(saved(wanted, "wanted"), "doc_id").select("doc_id", "digest", "anchors", "body")  # grows with docs
    rows = saved(_occurrences(texts, window, anchor), "occurrences")
    sequences = rows.where("words IS NOT NULL")
    many = sequences.select("anchor", "seq").distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    many = saved(many, "many")
    usual = sequences.join(small_side(many), "anchor", "left_anti").withColumn("route", F.col("anchor"))
    found = _matched(usual, window, shard_words)
    if not many.isEmpty():
        found = found.unionByName(_matched_hot(sequences.join(small_side(many), "anchor"), window, hot, shard_words))
    flagged = rows.where("words IS NULL").join(found, ["anchor", "seq"])
    starts = F.filter(F.transform("owners", lambda o, j: F.when(o < F.col("doc_id"), F.col("start") + j)), lambda x: x.isNotNull())
    flagged = flagged.select("doc_id", "digest", starts.alias("starts")).where(F.size("starts") > 0)
    return flagged.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT, shard_words: int = SHARD_WORDS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row: kept_text is the kept words, one blank between.

    Null and empty texts have no word. Rows with a null id keep all their words and take none from others. Rows that
    repeat an id with the same words get the same answer; with other words each row is judged by its own words, as
    part of the same document id. Other columns are left out, so names cannot clash.
    """
    anchor = window // 2
    rows = text_rows(docs, id_col, text_col)
    with temporary(docs.sparkSession, keep=("profile", "repeated")):
        profile = saved(_profile(rows, window, anchor, with_text), "profile")
        repeated = saved(repeated_windows(rows, profile, window, anchor, hot, shard_words), "repeated")
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_removed", pa.int64()), ("kept_sha", pa.string()), ("kept_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache(hash_words)
        for ids, digests, starts, texts in slices(batches):
            out = []
            for i, digest, at, t in zip(ids, digests, starts, texts):
                s = t.split()
                if xxhash.xxh3_128_digest(words.look(s)[0].tobytes()) != digest:
                    continue
                edge = np.zeros(len(s) + 1, np.int64)
                np.add.at(edge, np.array(at), 1)
                np.add.at(edge, np.array(at) + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(s, gone.tolist()) if not g)
                out.append((i, digest, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            if out:
                yield batch(schema, *zip(*out))

    texts = rows.join(repeated, "doc_id").select("doc_id", "digest", "starts", "body")
    changed = texts.mapInArrow(cut, "doc_id long, digest binary, n_removed long, kept_sha string, kept_text string").dropDuplicates(["doc_id", "digest"])
    owners = saved(profile.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies")), "text-owners")
    out = join_groups(profile.drop("anchors"), owners, "digest", "copies", "left").join(changed, ["doc_id", "digest"], "left")
    copy = F.coalesce(F.col("owner") < F.col("doc_id"), F.lit(False))
    columns = [
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.coalesce("kept_text", "plain")).alias("kept_text"))
    return out.select(*columns)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i + 1, i + 50), ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
own AS (SELECT g, min(doc_id) AS o FROM win GROUP BY g),
bad AS (SELECT win.doc_id, win.i FROM win JOIN own USING (g) WHERE o < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM bad, range(0, 50) r(k)),
cut AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ')
    WHEN n = len(ws) THEN ''
    ELSE (SELECT string_agg(u.x, ' ' ORDER BY u.p) FROM (SELECT unnest(ws) AS x, unnest(range(0, len(ws))) AS p) u
          WHERE NOT list_contains(ps, u.p)) END) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)
"""
}
