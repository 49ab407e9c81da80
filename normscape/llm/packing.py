"""Operator 5: best-fit packing planned on a length histogram.

Documents are tokenised once into pieces of at most `capacity` tokens. The histogram of piece lengths (at most
`capacity` entries) goes to the driver, which runs best-fit decreasing over counts: runs of equal sequences, not
documents, are placed. Each piece then gets its rank within its length (salted, so that a hot length is many small
sorts) and takes the planned slot by a join on length and rank.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normscape.llm.common import batch, gather_runs, saved, slices, text_rows

CAPACITY = 4096
END_ID = 1
#: Words, and cores of words, whose ids a Python worker keeps.
WORDS_KEPT = 250_000
#: Salts of a length: SALTS, or more once a salt would get over ROWS_PER_SALT pieces.
SALTS, ROWS_PER_SALT = 64, 1_000_000
#: Closing marks that are tokens of their own, apart from the letters or digits before them (no apostrophe: 's, 't ...).
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Slots of the plan are broadcast up to this many rows; beyond it the join shuffles.
PLAN_ROWS = 200_000
#: Letters before this one are their own NFC form, and all but this capital have one lower-case letter.
_LATIN_END, _TWO_LETTERS = "\u0250", "\u0130"
#: Byte-level alphabets write printable Latin-1 bytes as themselves and the others as letters from 256 on.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def _latin(word: str) -> bool:
    return word.isascii() or (max(word) < _LATIN_END and _TWO_LETTERS not in word)


class WordTokens:
    """Token ids of texts, a word (between blanks or line ends) at a time; ids of a word are worked out once.

    Equal to encoding the whole text: the tokenizer drops white space and no token, normaliser or special token of
    it reaches across a blank or a line end (tests compare the two).
    """

    def __init__(self, path: str, cap: int = WORDS_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.cap = Tokenizer.from_file(path), cap
        self.cores: dict[str, bytes] = {}  # ids of four bytes each, of which a list would take some five times as much
        #: a special token that stands between words when many new ones are encoded as one text
        self.mark = next(((t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        #: plain lower-case words need no normaliser and are one pre-token: the model alone gives their ids
        probes = ["the", "tokenisation", "hcz", "q", "straightforwardly", "einverge", "llamente", "zzxxyyqq", "é", "naïveté", "àßþœŵ", "señor", "ªº"]
        self.direct = all(self._by_model(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probes)
        self._clear()

    def _learnt(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from its core and its closing marks, which the tokenizer parts in any case."""
        cores, tails, at = [], [], []
        for i, w in enumerate(words):
            core = w
            if not w.isalpha():
                core = w.rstrip(_MARKS)
                if not core or not core[-1].isalnum() or "|" in w:
                    core = w
                elif len(core) < len(w):
                    tails.append(w[len(core) :])
                    at.append(i)
            cores.append(core.lower() if core.isascii() and (core.isalpha() or "|" not in w) or "|" not in w and _latin(core) else core)
        needed = set(cores).union(tails)
        new = list(needed - self.cores.keys())
        if len(self.cores) + len(new) > self.cap:
            self.cores = {c: self.cores[c] for c in needed & self.cores.keys()}
        self.cores.update(zip(new, self._ids(new)))
        ids = list(map(self.cores.__getitem__, cores))
        for i, t in zip(at, tails):
            ids[i] = ids[i] + self.cores[t]
        return ids

    def _by_model(self, word: str) -> list[int]:
        """The ids of a lower-case Latin word, which is one pre-token."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        if self.direct:
            plain = [w.isalpha() and w.islower() and _latin(w) for w in words]
            rest = iter(self._through_text([w for w, p in zip(words, plain) if not p]))
            return [array("I", self._by_model(w)).tobytes() if p else next(rest) for w, p in zip(words, plain)]
        return self._through_text(words)

    def _through_text(self, words: list[str]) -> list[bytes]:
        if self.mark is None or any(self.mark[0] in w for w in words):
            return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        out = []
        for s in range(0, len(words), 500):
            some = words[s : s + 500]
            ids = np.array(self.tokenizer.encode(self.mark[0].join(some), add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(ids == self.mark[1])
            out += [x.tobytes() for x in np.split(np.delete(ids, at), at - np.arange(len(at)))]
        return out

    def _clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _keep(self, words: list[str]) -> None:
        """Forgets all words but these."""
        at = np.array([0, *map(self.index.__getitem__, words)], np.int64)
        lengths = self.lengths[at]
        self.flat = self.flat[gather_runs(self.starts[at], lengths)]
        self.index = dict(zip(["", *words], range(len(at))))
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths

    def _learn(self, words: list[str]) -> None:
        ids = self._learnt(words)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), np.uint32))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        distinct = split.flatten().dictionary_encode()
        words = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist()
        at = list(map(self.index.get, words))
        if None in at:
            new = [w for w, i in zip(words, at) if i is None]
            if len(self.index) + len(new) > self.cap:
                self._keep([w for w, i in zip(words, at) if i])  # what is known is not worked out again
            self._learn(new)
            at = list(map(self.index.__getitem__, words))
        at = np.array(at, np.int64)[distinct.indices.to_numpy()]
        lengths = self.lengths[at]
        ids = self.flat[gather_runs(self.starts[at], lengths)]
        ends = np.append(0, np.cumsum(lengths))[split.offsets.to_numpy()[1:]]
        return np.split(ids, ends[:-1])


@functools.lru_cache(maxsize=1)
def worker_tokens(path: str, words_kept: int) -> WordTokens:
    """One for a Python worker: what a task has worked out serves the next."""
    return WordTokens(path, words_kept)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, words_kept: int = WORDS_KEPT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids, then end_id, cut every `capacity` tokens.

    Null and blank texts are end_id alone. A null id stays null; rows that repeat an id, or have none, are documents of
    their own. Other columns are left out, so names cannot clash; an empty table gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_tokens(tokenizer_path, words_kept)
        for doc_ids, bodies in slices(batches):
            out = []
            for i, ids in zip(doc_ids, words.encode([b.decode("utf-8", "replace") for b in bodies])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for p, s in enumerate(range(0, len(ids), capacity)):
                    x = ids[s : s + capacity]
                    out.append((i, p, s, len(x), zlib.crc32(x.tobytes())) + ((x.tolist(),) if with_ids else ()))
            yield batch(schema, *zip(*out))

    return text_rows(docs, id_col, text_col).mapInArrow(cut, ddl)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first_rank, items, items_each, first_sequence, offset) slots.

    A run of sequences with the same room left is one entry. The longest length comes first; its pieces go to the
    sequences with the least room that still holds one, as many into each as fit, before new sequences are opened.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    keys: list[int] = []
    slots, opened = [], 0

    def give(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                bisect.insort(keys, left)
            room.setdefault(left, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect.bisect_left(keys, length)
            if i < len(keys):
                left = keys[i]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], keys[i]
            else:
                left, first = capacity, opened
                n = -(-todo // (capacity // length))
                opened += n
            each = left // length
            full = min(n, todo // each)
            if full:
                slots.append((length, rank, full * each, each, first, capacity - left))
                give(left - each * length, first, full)
                rank, todo, first, n = rank + full * each, todo - full * each, first + full, n - full
            if n and todo:
                some = min(todo, each)
                slots.append((length, rank, some, some, first, capacity - left))
                give(left - some * length, first, 1)
                rank, todo, first, n = rank + some, todo - some, first + 1, n - 1
            give(left, first, n)
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add (sequence_id, offset) to pieces (doc_id, piece, length, ...): a saved() table, as it is read several times.

    Repeated rows are separate pieces; ties within a length are ordered by (doc_id, piece). Columns named sequence_id
    or offset are replaced. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    spark = pieces.sparkSession
    names = "slot_length long, first_rank long, items long, items_each long, first_sequence long, first_offset long"
    planned = spark.createDataFrame(slots, names)
    salts = max(SALTS, -(-max(histogram.values(), default=0) // ROWS_PER_SALT))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__row", F.row_number().over(within)).join(bases, ["length", "__salt"]).withColumn("__rank", F.col("__base") + F.col("__row") - 1)
    planned = F.broadcast(planned) if len(slots) <= PLAN_ROWS else planned
    inside = (F.col("length") == F.col("slot_length")) & (F.col("__rank") >= F.col("first_rank")) & (F.col("__rank") < F.col("first_rank") + F.col("items"))
    nth = F.col("__rank") - F.col("first_rank")
    return ranked.join(planned, inside).select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("items_each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("items_each") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces made with_ids; a sequence is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(saved(token_pieces(docs, tokenizer_path()), "pieces", arrow_rows=10_000))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
