"""Operator 1: language ID by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams on the executors over a bounded sample of labelled documents (MAX_DOCS_PER_LANG per
language in expectation, chosen by a hash of the id); the log-probability matrix, buckets x languages, is
broadcast, and batches are scored by gathering its rows for the n-grams that occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normscape.llm.common import batch, slices, text_rows

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MAX_DOCS_PER_LANG = 4000
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
#: Log-probabilities that are gathered at once.
_GATHERED = 1 << 21
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_PAD = max(ORDERS)
_letters: list[np.ndarray] = []


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # (BUCKETS + 1) x languages; the last row is zero, for what is no n-gram


def letter_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for all else; built once in each worker."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def ngram_buckets(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of each position (BUCKETS where there is no letter), and each text's first position.

    Anything but letters counts as one blank; texts are padded, so that no n-gram spans two of them.
    """
    table, parts, starts, at = letter_table(), [], [], 0
    blank = np.zeros(_PAD, np.uint32)
    for t in texts:
        codes = table[np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = codes != 0
        keep[1:] |= keep[:-1]
        codes = codes[keep]
        starts.append(at)
        parts += [blank[:1], codes, blank]
        at += 1 + len(codes) + _PAD
    stream = np.concatenate(parts + [blank])
    n, out = at, []
    for order in ORDERS:
        h, some = np.full(n, order, np.uint32), np.zeros(n, bool)
        for j in range(order):
            h = (h ^ stream[j : n + j]) * _FACTORS[j]
            h ^= h >> np.uint32(15)
            some |= stream[j : n + j] != 0
        out.append(np.where(some, h & np.uint32(BUCKETS - 1), BUCKETS))
    return out, np.array(starts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS_PER_LANG) -> LanguageModel:
    """Learn from text and non-null label. No labelled row at all gives a model without languages (all `und`)."""
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS + 1, 0), np.float32))
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(scale * min(1.0, max_docs / n)))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    chosen = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(scale)) < share[F.col(lang_col)])
    numbered = chosen.select(number[F.col(lang_col)].alias("lang"), F.col(text_col).cast("binary").alias("body"))
    schema = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * (BUCKETS + 1), np.int64)
        for langs, texts in slices(batches):
            grams, starts = ngram_buckets(texts)
            lengths = np.diff(np.append(starts, len(grams[0])))
            base = np.repeat(np.array(langs, np.int64) * (BUCKETS + 1), lengths)
            for g in grams:
                total += np.bincount(base + g, minlength=len(total))
        total = total.reshape(len(languages), -1)
        total[:, BUCKETS] = 0
        lang, bucket = np.nonzero(total)
        yield batch(schema, pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket]))

    table = numbered.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = table.toPandas()  # at most languages x BUCKETS rows
    freq = np.ones((BUCKETS + 1, len(languages)))
    freq[got["bucket"], got["lang"]] += got["n"]
    log_prob = np.log(freq / freq[:BUCKETS].sum(0))
    log_prob -= log_prob.max(1, keepdims=True)  # a bucket's constant cancels out
    log_prob[BUCKETS] = 0
    prior = np.array([counts[k] for k in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), log_prob.astype(np.float32))


def posteriors(texts: list[bytes], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; `und` and 0 without a letter or a model."""
    grams, starts = ngram_buckets(texts)
    if model.languages:
        total = np.tile(model.log_prior, (len(texts), 1))
        step = max(1, _GATHERED // len(model.languages))
        for s in range(0, len(grams[0]), step):  # so many positions at a time, whatever a text's length
            first = int(np.searchsorted(starts, s, side="right")) - 1
            inside = starts[first : int(np.searchsorted(starts, s + step))]
            at = np.maximum(inside - s, 0)
            for g in grams:
                total[first : first + len(at)] += np.add.reduceat(model.log_prob[g[s : s + step]], at)
    else:
        total = np.zeros((len(texts), 1))
    seen = np.add.reduceat(grams[0] != BUCKETS, starts) > 0
    odds = np.exp(total - total.max(1, keepdims=True))
    best = total.argmax(1)
    p = odds[np.arange(len(best)), best] / odds.sum(1)
    known = seen & bool(model.languages)
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, p, 0.0)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior probability, from the text alone.

    Null text, or text without a letter: `und`, score 0. Equal probabilities go to the language first in order.
    Repeated rows each get their row; other columns are left out, so names cannot clash.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            found, p = posteriors(texts, sent.value)
            yield batch(schema, ids, found, pa.array(p))

    return text_rows(docs, id_col, text_col).mapInArrow(score, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language with a posterior of `least` or more.

    Each row is judged by its own text, so rows that share an id, or have none, do not decide about one another.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.table({"body": b.column(text_col).fill_null("").cast(pa.binary())}).to_batches()
            good = [(x != UNDETERMINED) & (y >= least) for (part,) in slices(texts) for x, y in zip(*posteriors(part, sent.value))]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the stated folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
