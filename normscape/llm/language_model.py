"""Operator 9: LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(subclass | class, context) * P(word | subclass). Both class factors are softmaxes
over hashed bigram, skip and trigram features of the two words before, the second one's features hashed together with the
class; the word factor is the closed form of a softmax over word features with one added count. Counts cover every training
token. Of the TOP words (a bound on what is broadcast) the CLUSTERED most frequent get classes and subclasses by k-means on
their neighbours in all training documents; all others, known or not, share a class whose subclasses are dealt by hash, and
the counts of those beyond TOP are joined by a shuffle. Texts are split once, into a table of word hashes that all later
passes read. Weights are trained by gradient steps in the tasks over all training documents, each once, and averaged
(weighted by occurrences) after each of ROUNDS rounds; so they depend on how the table is cut into tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normscape.llm.common import WordCache, batch, gather_runs, hash_words, mix, saved, slices, temporary, text_rows
from normscape.llm.language_id import fold

TOP, CLUSTERED = 400_000, 16_384
#: Classes, and subclasses of each: a leaf is class * SUBS + subclass.
CLASSES = SUBS = 16
LEAVES = CLASSES * SUBS
#: Weight rows of a factor: a power of two, one for so many training tokens, within these bounds (16 MB are broadcast at most).
TOKENS_A_FEATURE, LEAST_FEATURES, MOST_FEATURES = 4096, 1 << 15, 1 << 17
ROUNDS, STEP, STEP_TOKENS = 2, 0.5, 1 << 15
BLOCK_TOKENS = 2048
NEIGHBOURS = 32
_END = xxhash.xxh3_64_intdigest(b"\nend\n")  # as hash_words gives; no word holds white space
_START = np.uint64(xxhash.xxh3_64_intdigest(b"\nstart\n"))
_END_CLASS, _RARE = 0, 1
_ROWS = 64  # weight rows of one exchanged block
_SHORT = 4  # rows of a run that is added up with others


@dataclass
class Vocabulary:
    """The most frequent words: sorted hashes, their counts and leaves; and the corpus totals."""

    hashes: np.ndarray
    counts: np.ndarray
    leaves: np.ndarray
    leaf_total: np.ndarray  # tokens + types (+ 1 unseen in those of the rare class) of each leaf
    tokens: int
    types: int
    least: int  # words with fewer occurrences are not in hashes

    def __post_init__(self):
        # hashes are spread evenly, so of a table by their first bits a place holds about one
        bits = max(1, len(self.hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.places = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        ends = np.append(self.hashes, np.uint64(2**64 - 1))
        at = np.take(self.places, (h >> self.shift).astype(np.int64)).astype(np.int64)
        left = np.flatnonzero(ends[at] < h)
        while len(left):
            at[left] += 1
            left = left[ends[at[left]] < h[left]]
        return np.where((ends[at] == h) & (at < len(self.hashes)), at, -1)

    def leaves_of(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf of each word, by its hash and what find() gives for it."""
        return np.where(at >= 0, np.append(self.leaves, 0)[at], rare_leaf(h))

    @property
    def features(self) -> int:
        wanted = max(1, self.tokens // TOKENS_A_FEATURE)
        return int(np.clip(1 << (wanted - 1).bit_length(), LEAST_FEATURES, MOST_FEATURES))


def rare_leaf(h: np.ndarray) -> np.ndarray:
    return (_RARE * SUBS + (h & np.uint64(SUBS - 1)).astype(np.int64)).astype(np.int64)


def tokens_of(texts: list[bytes], words: WordCache) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the words of each text, lower-cased, with one end after each text; and the texts' token counts."""
    split = [t.lower().split() + [b"\nend\n"] for t in texts]
    return words.look([w for s in split for w in s]), np.fromiter(map(len, split), np.int64, len(split))


def hashed_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, body) rows with each text replaced by its tokens' 64-bit hashes, eight bytes each."""
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache(hash_words)  # the end is hashed like a word
        for ids, texts in slices(batches):
            (h,), lengths = tokens_of(texts, words)
            ends = np.append(0, 8 * np.cumsum(lengths)).astype(np.int32)
            yield batch(schema, ids, pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(h)]))

    return docs.mapInArrow(split, "doc_id long, body binary")


def hashes_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a slice of hashed_tokens(), and the documents' token counts."""
    return np.frombuffer(b"".join(bodies), np.uint64), np.fromiter(map(len, bodies), np.int64, len(bodies)) // 8


def count_words(tokens: DataFrame) -> DataFrame:
    """(word, n) of hashed_tokens(): word as its 64-bit hash. Tasks send running sums, not tokens."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return h, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, bodies in slices(batches):
            h, _ = hashes_of(bodies)
            parts.append(np.unique(h, return_counts=True))
            size += len(parts[-1][0])
            if size > 1_500_000:
                parts = [merge(parts)]
                size = len(parts[0][0])
                if size > 1_000_000:
                    yield batch(schema, pa.array(parts[0][0].astype(np.int64)), pa.array(parts[0][1]))
                    parts, size = [], 0
        if parts:
            h, n = merge(parts)
            yield batch(schema, pa.array(h.astype(np.int64)), pa.array(n))

    return tokens.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _clusters(x: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(12):
        at = (x @ centres.T).argmax(1)
        sums = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], 1)
        centres = np.where(sums.any(1)[:, None], sums, centres)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return (x @ centres.T).argmax(1)


def build_vocabulary(train: DataFrame, counts: DataFrame) -> Vocabulary:
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()  # 64 rows at most
    least, held = 1 << 62, 0
    for b, n in sorted(((r[0], r[1]) for r in sizes), reverse=True):
        if held + n > TOP:
            break
        least, held = 1 << b, held + n
    top = counts.where(F.col("n") >= least).toPandas()  # TOP rows at most
    hashes, n = top["word"].to_numpy(np.int64).astype(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    vocab = Vocabulary(hashes, n, rare_leaf(hashes), np.ones(LEAVES), int(total), int(types), least)
    chosen = np.lexsort((hashes, -n))[:CLUSTERED]
    if len(chosen):
        number = np.full(len(n), -1)
        number[chosen] = np.arange(len(chosen))
        near = _neighbours(train, vocab, number)
        x = np.zeros((len(chosen), 2 * NEIGHBOURS))
        x[near["w"], near["c"]] = near["n"]
        x = np.sqrt(x)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        own = 2 + _clusters(x, CLASSES - 2)
        for k in np.unique(own):
            at = chosen[own == k]
            vocab.leaves[at] = k * SUBS + _clusters(x[own == k], SUBS)
    end = vocab.find(np.array([_END], np.uint64))[0]
    if end >= 0:
        vocab.leaves[end] = _END_CLASS * SUBS
    mass = np.bincount(vocab.leaves, n + 1.0, LEAVES)
    rest = counts.where(F.col("n") < least).groupBy(F.col("word").bitwiseAND(F.lit(SUBS - 1)).alias("s")).agg(F.sum(F.col("n") + 1)).collect()  # SUBS rows
    mass[_RARE * SUBS : (_RARE + 1) * SUBS] += 1
    for sub, more in rest:
        mass[_RARE * SUBS + sub] += more
    vocab.leaf_total = np.maximum(mass, 1.0)
    return vocab


def _neighbours(train: DataFrame, vocab: Vocabulary, number: np.ndarray):
    """Counts of (clustered word, hashed neighbour) over all of train, as a pandas frame: CLUSTERED x 2 NEIGHBOURS rows at most."""
    sent = train.sparkSession.sparkContext.broadcast((vocab, number))
    schema = pa.schema([("w", pa.int32()), ("c", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, number = sent.value
        size = 2 * NEIGHBOURS
        total = np.zeros((number.max() + 1) * size, np.int64)
        for _, bodies in slices(batches):
            h, _ = hashes_of(bodies)
            at = vocab.find(h)
            w = np.where(at >= 0, number[at], -1)
            side = (mix(h) % np.uint64(NEIGHBOURS)).astype(np.int64)
            for mine, other, shift in ((w[1:], side[:-1], 0), (w[:-1], side[1:], NEIGHBOURS)):
                ok = mine >= 0
                total += np.bincount(mine[ok] * size + other[ok] + shift, minlength=len(total))
        at = np.flatnonzero(total)
        yield batch(schema, pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total[at]))

    packed = pa.schema([(c, pa.binary()) for c in "wcn"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(packed, *([c.to_numpy(zero_copy_only=False).tobytes()] for c in b.columns))

    summed = train.mapInArrow(count, "w int, c int, n long").groupBy("w", "c").agg(F.sum("n").alias("n"))
    parts = summed.mapInArrow(pack, "w binary, c binary, n binary").collect()  # 16 bytes a cell instead of a Row
    return pd.DataFrame({c: np.frombuffer(b"".join(p[c] for p in parts), t) for c, t in (("w", np.int32), ("c", np.int32), ("n", np.int64))})


def contexts(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes (templates x tokens) of the two words before each token; documents begin with two starts."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = np.cumsum(lengths) - lengths
    one[first] = _START
    two[first] = _START
    second = first[lengths > 1] + 1
    two[second] = _START
    return np.stack([mix(x) for x in (one + np.uint64(1), two + np.uint64(2), one * np.uint64(5) + mix(two) + np.uint64(3))])


def class_rows(context: np.ndarray, features: int) -> np.ndarray:
    """Weight rows (templates and a bias x tokens) of the class factor."""
    rows = np.full((len(context) + 1, context.shape[1]), features, np.int32)
    rows[:-1] = context & np.uint64(features - 1)
    return rows


def subclass_rows(context: np.ndarray, classes: np.ndarray, features: int) -> np.ndarray:
    """Weight rows of the subclass factor: features with the class, and a bias for each."""
    rows = np.empty((len(context) + 1, context.shape[1]), np.int32)
    salt = (classes + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows[:-1] = ((context ^ salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (features.bit_length() - 1))
    rows[-1] = features + classes
    return rows


def _scores(weights: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Unnormalised log-probabilities, the largest 0."""
    np.take(weights, rows[0], axis=0, out=out, mode="clip")
    more = np.empty_like(out)
    for x in rows[1:]:
        np.take(weights, x, axis=0, out=more, mode="clip")
        out += more
    out -= out.max(1, keepdims=True)


def log_probs(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the softmax's probability of each target."""
    out = np.empty(rows.shape[1])
    z = np.empty((min(BLOCK_TOKENS, rows.shape[1]), weights.shape[1]), np.float32)
    for s in range(0, len(out), BLOCK_TOKENS):  # blocks that stay in a core's cache
        r, t = rows[:, s : s + BLOCK_TOKENS], target[s : s + BLOCK_TOKENS]
        own = z[: len(t)]
        _scores(weights, r, own)
        out[s : s + BLOCK_TOKENS] = own[np.arange(len(t)), t] - np.log(np.exp(own).sum(1))
    return out


def gradients(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the negative log-probability of each target, by its softmax's inputs."""
    out = np.empty((rows.shape[1], weights.shape[1]), np.float32)
    for s in range(0, len(out), BLOCK_TOKENS):
        r, z = rows[:, s : s + BLOCK_TOKENS], out[s : s + BLOCK_TOKENS]
        _scores(weights, r, z)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
    out[np.arange(len(target)), target] -= 1
    return out


def _sums(g: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of g: those at order[first : first + n]. Most runs are short and are added up all at once."""
    out = np.take(g, order[first], axis=0)
    left = np.flatnonzero(n > 1)
    for k in range(1, _SHORT):
        short = left[n[left] <= _SHORT]
        if not len(short):
            break
        out[short] += np.take(g, order[first[short] + k], axis=0)
        left = left[n[left] > k + 1]
    left = np.flatnonzero(n > _SHORT)
    if len(left):
        inside = order[gather_runs(first[left], n[left])]
        out[left] = np.add.reduceat(np.take(g, inside, axis=0), np.cumsum(n[left]) - n[left])
    return out


def take_step(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One gradient step on a block of tokens; a row moves less the more often it has been seen."""
    g = gradients(weights, rows, target)
    narrow = np.uint16 if len(weights) <= 1 << 16 else np.uint32  # short keys sort by radix
    for x in rows:
        order = np.argsort(x.astype(narrow), kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(x[order]) > 0))
        row, n = x[order][first], np.diff(np.append(first, len(x)))
        seen[row] += n
        moved = np.take(weights, row, axis=0)
        moved -= _sums(g, order, first, n) * (STEP / (np.sqrt(seen[row] * n) + 4)).astype(np.float32)[:, None]
        weights[row] = moved


def first_weights(vocab: Vocabulary) -> np.ndarray:
    """Weights of both factors, one table after the other: features, then biases, which begin at the leaves' shares."""
    n = vocab.features
    weights = np.zeros((n + 1 + n + CLASSES, SUBS), np.float32)
    mass = vocab.leaf_total.reshape(CLASSES, SUBS)
    weights[n] = np.log(mass.sum(1) / mass.sum())
    weights[-CLASSES:] = np.log(mass / mass.sum(1, keepdims=True))
    return weights


def train_round(docs: DataFrame, vocab: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """One round: every task steps through its documents from the same weights; the moves are averaged."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, weights))
    schema = pa.schema([("block", pa.int32()), ("moved", pa.binary())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = sent.value
        w, seen, n = start.copy(), np.zeros(len(start)), vocab.features
        for _, bodies in slices(batches):
            h, lengths = hashes_of(bodies)
            leaf, context = vocab.leaves_of(h, vocab.find(h)), contexts(h, lengths)
            for s in range(0, len(h), STEP_TOKENS):
                k, sub = np.divmod(leaf[s : s + STEP_TOKENS], SUBS)
                c = context[:, s : s + STEP_TOKENS]
                take_step(w[: n + 1], seen[: n + 1], class_rows(c, n), k)
                take_step(w[n + 1 :], seen[n + 1 :], subclass_rows(c, k, n), sub)
        moved = np.concatenate([(w - start) * seen[:, None], seen[:, None]], 1)
        for b in range(0, len(w), _ROWS):
            if seen[b : b + _ROWS].any():
                yield batch(schema, [b // _ROWS], [moved[b : b + _ROWS].astype(np.float64).tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for blocks, moves in slices(batches):
            for b, m in zip(blocks, moves):
                m = np.frombuffer(m)
                sums[b] = sums[b] + m if b in sums else m
        if sums:
            yield batch(schema, list(sums), [m.tobytes() for m in sums.values()])

    moves = docs.mapInArrow(learn, "block int, moved binary").repartition("block").mapInArrow(add, "block int, moved binary")
    out = weights.copy()
    for b, m in ((r[0], np.frombuffer(r[1]).reshape(-1, SUBS + 1)) for r in moves.toLocalIterator()):
        rows = slice(b * _ROWS, b * _ROWS + len(m))
        out[rows] += (m[:, :-1] / np.maximum(m[:, -1:], 1)).astype(np.float32)
    return out


def score(docs: DataFrame, vocab: Vocabulary, weights: np.ndarray, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of hashed_tokens() rows, a row for each row."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, weights))
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, w = sent.value
        logs, mass, n = np.append(np.log10(vocab.counts + 1.0), 0.0), np.log10(vocab.leaf_total), vocab.features
        for keys, ids, bodies in slices(batches):
            h, lengths = hashes_of(bodies)
            at = vocab.find(h)
            leaf, context = vocab.leaves_of(h, at), contexts(h, lengths)
            model = logs[at] - mass[leaf]
            for s in range(0, len(h), STEP_TOKENS):
                k, sub = np.divmod(leaf[s : s + STEP_TOKENS], SUBS)
                c = context[:, s : s + STEP_TOKENS]
                found = log_probs(w[: n + 1], class_rows(c, n), k) + log_probs(w[n + 1 :], subclass_rows(c, k, n), sub)
                model[s : s + STEP_TOKENS] += found / np.log(10)
            first = np.cumsum(lengths) - lengths
            other = at < 0
            rare, ends = h[other].astype(np.int64), np.add.reduceat(other, first, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ends)).astype(np.int32)), pa.array(rare))
            yield batch(schema, keys, ids, pa.array(lengths), pa.array(lengths - ends), pa.array(np.add.reduceat(logs[at], first)), pa.array(np.add.reduceat(model, first)), lists)

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "body")
    part = saved(keyed.mapInArrow(sparse, "key long, doc_id long, n_tokens long, n_known long, base double, model double, rare array<long>"), "scored")
    rest = part.select("key", F.explode("rare").alias("word")).join(counts.where(F.col("n") < vocab.least), "word")
    rest = rest.groupBy("key").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * F.log10(F.lit(float(vocab.tokens + vocab.types + 1)))
    return part.drop("rare").join(rest, "key", "left").select("doc_id", "n_tokens", (F.col("n_known") + more).alias("n_known"), base.alias("base_score"), (F.col("model") + logs).alias("score"))


def score_corpus(docs: DataFrame, learns, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): learns is the condition on doc_id to learn from.

    Null text counts as empty (one end token). Repeated rows are learnt and scored each; a null id is never learnt
    from unless the condition holds for it. With nothing to learn from, every token is unknown. Other columns are
    left out, so names cannot clash.
    """
    with temporary(docs.sparkSession, keep=("counts", "scored")):
        rows = saved(hashed_tokens(text_rows(docs, id_col, text_col)), "tokens")
        train = rows.where(learns)
        counts = saved(count_words(train), "counts")
        vocab = build_vocabulary(train, counts)
        weights = first_weights(vocab)
        for i in range(ROUNDS):
            weights = train_round(train.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == i), vocab, weights)
        out = score(rows, vocab, weights, counts)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold("doc_id", 7) == 2
    return score_corpus(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLES: dict[str, str] = {}
