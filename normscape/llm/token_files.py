"""Operator 12: token ids in files of Re-Pair compressed shards.

Documents are sorted into range partitions by id. A task encodes its documents in order, and every SHARD_IDS ids, cut
anywhere, become a shard: a grammar of its own, got by replacing frequent pairs of neighbours by nonterminals round after
round, and what is left of the ids. No pair reaches over the end of a document, so a document is a stretch of a shard's
symbols, and the expansion lengths of the rules say where in them its nth id is.

The files are Parquet tables written by Spark (so a lost executor's shards are written again, and readers see whole tables
alone), a row a shard: what it holds of which documents, and the bytes of `pack_shard`.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normscape.llm.common import small_batches, batch, gather_runs, shared_dir, slices, small_side

SHARD_IDS = 1 << 18
#: Uses that a rule must have, and what a round must save of the symbols for another to follow.
LEAST_USES, LEAST_GAIN = 4, 1 / 32
_SLOT_BITS = 17
_SLOTS = 1 << _SLOT_BITS
#: Pieces of text (a word and what stands before it) whose ids a Python worker keeps.
PIECES_KEPT = 500_000
#: Texts are encoded together up to about so many bytes: of more pieces fewer are distinct.
_TEXT_BYTES = 4 << 20
_MAGIC = b"RPG1"
#: Byte-level alphabets write printable Latin-1 bytes as themselves and the others as letters from 256 on; here a line end,
#: which stands between words, stays.
_LETTERS = np.arange(256, dtype="<u2")
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_LETTERS[_OTHERS] = 256 + np.arange(len(_OTHERS))
_LETTERS[10] = 10
#: Of each byte: 3 an ASCII letter, 2 another printable ASCII character, 1 part of a character beyond ASCII, 0 the rest.
_KINDS = np.array([3 if chr(b).isalpha() and b < 128 else 2 if 33 <= b <= 126 else b >> 7 for b in range(256)], np.uint8)

# The format of a shard's bytes: the magic, a head of 6 little-endian uint32 (terminals, rules, rounds, symbols, bytes a
# symbol, 0), then uint32 terminals, uint32 rules of each round, uint32 left and right symbols of the rules, uint32
# expansion lengths of the rules, and the symbols. Symbols count the terminals first, then the rules.


@dataclass
class Grammar:
    terminals: np.ndarray  # the ids that occur
    rounds: np.ndarray  # rules of each round
    left: np.ndarray  # of each rule, as symbols
    right: np.ndarray
    lengths: np.ndarray  # ids of each rule

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, ids): where the ids of each symbol stand in ids."""
        n = len(self.terminals)
        length = np.concatenate([np.ones(n, np.int64), self.lengths])
        start = np.cumsum(length) - length
        ids = np.empty(int(length.sum()), np.uint32)
        ids[:n] = self.terminals
        at = 0
        for k in self.rounds:  # rules of a round use older symbols alone
            rule = n + np.arange(at, at + k)
            pair = np.stack([self.left[at : at + k], self.right[at : at + k]], 1).ravel()
            if k:
                ids[start[rule[0]] : start[rule[0]] + int(length[rule].sum())] = ids[gather_runs(start[pair], length[pair])]
            at += k
        return start, length, ids


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, least_uses: int = LEAST_USES) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """(grammar, symbols, symbols of each stretch). ends: where each stretch of ids ends; pairs stay inside one.

    Each round counts all pairs, takes those used least_uses times or more, and of places that overlap the one whose pair
    is more frequent; pairs that are then left with fewer uses wait for the next round.
    """
    there = np.zeros(int(ids.max(initial=0)) + 1, bool)
    there[ids] = True
    terminals = np.flatnonzero(there).astype(np.uint32)
    seq = (np.cumsum(there) - 1).astype(np.int32)[ids]
    last = np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    length = np.ones(len(terminals), np.int64)
    rounds, pairs = [], []
    while len(seq) > 1:
        key = seq[:-1].astype(np.int64)
        key <<= 32
        key |= seq[1:]
        key[last[:-1]] = -1  # no pair
        ordered = np.sort(key)
        begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        uses = np.diff(np.append(begins, len(key)))
        often = np.flatnonzero((uses >= least_uses) & (ordered[begins] >= 0))
        often = often[np.argsort(uses[often], kind="stable")]
        uses, distinct = uses[often].astype(np.int32), ordered[begins[often]]
        slots = np.full(_SLOTS, len(distinct), np.int32)  # of frequent pairs that share a slot this round takes the most frequent
        slots[_slot(distinct)] = np.arange(len(distinct), dtype=np.int32)
        pair = slots[_slot(key)]
        # how often a pair occurs, and the parity of the place: of equally frequent neighbours every other is taken
        weight = np.append(2 * uses, np.int32(0))[pair]
        weight[np.append(distinct, -2)[pair] != key] = 0
        weight[1::2] += weight[1::2] > 0
        keep = weight > 0
        keep[1:] &= weight[1:] > weight[:-1]
        keep[:-1] &= weight[:-1] > weight[1:]
        at = np.flatnonzero(keep)
        own = pair[at]
        used = np.bincount(own, minlength=len(distinct))
        kept = used[own] >= least_uses
        at, own = at[kept], own[kept]
        if len(at) < max(1, LEAST_GAIN * len(seq)):
            break
        new = np.flatnonzero(used >= least_uses)
        number = np.zeros(len(distinct), np.int32)
        number[new] = len(length) + np.arange(len(new))
        left, right = distinct[new] >> 32, distinct[new] & 0xFFFFFFFF
        pairs.append((left, right))
        rounds.append(len(new))
        length = np.append(length, length[left] + length[right])
        seq[at] = number[own]
        last[at] = last[at + 1]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq, last = seq[stays], last[stays]
    left, right = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.uint32) for x in (zip(*pairs) if pairs else ((), ())))
    filled = np.append(0, np.cumsum(length[seq]))
    symbols = np.diff(np.searchsorted(filled, np.append(0, ends)))
    return Grammar(terminals, np.array(rounds, np.uint32), left, right, length[len(terminals) :]), seq, symbols


def pack_shard(g: Grammar, symbols: np.ndarray) -> bytes:
    most = len(g.terminals) + len(g.left)
    width = 2 if most <= 1 << 16 else 3 if most <= 1 << 24 else 4
    head = np.array([len(g.terminals), len(g.left), len(g.rounds), len(symbols), width, 0], "<u4")
    body = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return _MAGIC + b"".join(x.astype("<u4").tobytes() for x in (head, g.terminals, g.rounds, g.left, g.right, g.lengths)) + body.tobytes()


def unpack_shard(data: bytes) -> tuple[Grammar, np.ndarray]:
    if data[:4] != _MAGIC:
        raise ValueError("no shard of token ids")
    terminals, rules, rounds, n, width, _ = np.frombuffer(data, "<u4", 6, 4).astype(int)
    parts, at = [], 28
    for k in (terminals, rounds, rules, rules, rules):
        parts.append(np.frombuffer(data, "<u4", k, at).astype(np.int64))
        at += 4 * k
    body = np.zeros((n, 4), np.uint8)
    body[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return Grammar(*parts), body.view("<u4").ravel().astype(np.int64)


def _latin(word: str) -> bool:
    """Letters alone, of those that every version of the character tables has."""
    return word.isalpha() and max(word) < "\u0250"


class ByteTokens:
    """Token ids of whole texts by a byte-level tokenizer, a piece at a time; ids of a piece are worked out once.

    Pieces are cut where the tokenizer's own pattern always ends a match: before white space that follows another
    character, after a line end of its own, and between a letter and a mark (tests compare the two). A text with an added token's
    string goes to the tokenizer whole.
    """

    def __init__(self, path: str, cap: int = PIECES_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.cap = Tokenizer.from_file(path), cap
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)  # a letter is a byte
        self.model_alone = Tokenizer(self.tokenizer.model)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _keep(self, pieces: list[bytes]) -> None:
        """Forgets all pieces but these."""
        at = np.array(list(map(self.index.__getitem__, pieces)), np.int64)
        lengths = self.lengths[at]
        self.flat = self.flat[gather_runs(self.starts[at], lengths)]
        self.index = dict(zip(pieces, range(len(at))))
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths

    @staticmethod
    def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin, the texts' own starts among them. A character beyond ASCII is cut off only if its last
        bytes show that it is no white space (C2 A0, E2 80 83 ...), or before a mark that it is a Latin letter (C3 ..)."""
        before, earlier = np.append(np.uint8(32), data[:-1]), np.append(np.zeros(2, np.uint8), data[:-2])[: len(data)]
        kind = _KINDS[before]
        solid = kind >= 2
        wide = kind == 1
        solid[wide] = ~np.isin(earlier[wide], np.array([0xC2, 0x80, 0x81, 0x9A], np.uint8))
        letter = kind == 3
        letter[wide] = (earlier[wide] == 0xC3) & (before[wide] != 0x97) & (before[wide] != 0xB7)
        own = _KINDS[data]
        begins = ((data == 32) | (data == 10)) & solid
        begins |= (own == 2) & letter | (own >= 2) & (before == 10) & np.append(False, begins[:-1])  # a line end alone
        begins[starts[starts < len(data)]] = True
        return np.flatnonzero(begins)

    def _learn(self, pieces: list[bytes]) -> None:
        """Latin letters alone, or digits, with or without a blank before them, are one match: they go to the model as they
        are, many at a time, and the bytes of the tokens say whose they are."""
        plain, rest = [], []
        for p in pieces:
            core = p[1:] if p[0] == 32 else p
            if core.isalpha() or core.isdigit():  # of ASCII alone
                plain.append(p)
            else:
                (plain if not core.isascii() and _latin(core.decode("utf-8", "replace")) else rest).append(p)
        words = _LETTERS[np.frombuffer(b"\n".join(plain), np.uint8)].tobytes().decode("utf-16-le").split("\n") if plain else []
        some = [words[i : i + 5000] for i in range(0, len(words), 5000)]
        ids = [np.array(e.ids, np.uint32) for e in self.model_alone.encode_batch_fast(some, is_pretokenized=True, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *ids])
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        lengths = np.diff(np.append(-1, np.searchsorted(np.cumsum(self.bytes_of[ids]), ends)))
        others = [e.ids for e in self.tokenizer.encode_batch([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)]
        lengths = np.append(lengths, np.fromiter(map(len, others), np.int64, len(others)))
        self.index.update(zip(itertools.chain(plain, rest), range(len(self.index), len(self.index) + len(pieces))))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.flat = np.concatenate([self.flat, ids, np.fromiter(itertools.chain.from_iterable(others), np.uint32)])

    def encode(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has)."""
        odd = {i: self.tokenizer.encode(b.decode("utf-8", "replace"), add_special_tokens=False).ids for i, b in enumerate(bodies) if any(a in b for a in self.added)}
        if odd:
            ids, lengths = self.encode([b"" if i in odd else b for i, b in enumerate(bodies)])
            at = np.cumsum(lengths)[list(odd)]
            lengths[list(odd)] = [len(x) for x in odd.values()]
            return np.insert(ids, np.repeat(at, lengths[list(odd)]), np.concatenate(list(odd.values()))), lengths
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        data = b"".join(bodies)
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(bodies), np.int64)
        starts = np.cumsum(sizes) - sizes
        begins = self.cuts(np.frombuffer(data, np.uint8), starts)
        offsets = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
        distinct = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        pieces = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.index.get, pieces))
        if None in at:
            new = [p for p, i in zip(pieces, at) if i is None]
            if len(self.index) + len(new) > self.cap:
                self._keep([p for p, i in zip(pieces, at) if i is not None])  # what is known is not worked out again
            self._learn(new)
            at = list(map(self.index.__getitem__, pieces))
        at = np.array(at, np.int64)[distinct.indices.to_numpy()]
        lengths = self.lengths[at]
        ids = self.flat[gather_runs(self.starts[at], lengths)]
        filled = np.append(0, np.cumsum(lengths))
        ends = filled[np.searchsorted(begins, starts + sizes)]
        return ids, np.diff(np.append(0, ends))


@functools.lru_cache(maxsize=1)
def worker_tokens(path: str, pieces_kept: int) -> ByteTokens:
    """One for a Python worker: what a task has worked out serves the next."""
    return ByteTokens(path, pieces_kept)


_TABLE = "part int, shard int, before long, n_ids long, doc_ids array<long>, nths array<long>, starts array<long>, n_ids_each array<long>, n_symbols_each array<long>, data binary"
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "nths", "starts", "n_ids_each", "n_symbols_each")]
    + [("data", pa.binary())]
)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, pieces_kept: int = PIECES_KEPT) -> None:
    """Write the ids of all texts, each followed by end_id, in ascending order of id_col to a table at path.

    Null text counts as empty, a null id comes first, rows that repeat an id follow in order of a hash of their text. A
    row of the table is a shard of at most shard_ids ids: part and shard (its place), before (the ids before it in its
    part) and n_ids, and for each of its documents the id, nth (the document's number in the part), start (the ids of the
    document before this shard), and ids and symbols here. An empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"))
    rows = rows.select("doc_id", F.xxhash64("body").alias("__hash"), F.monotonically_increasing_id().alias("__row"), F.col("body").cast("binary").alias("body"))
    keys = ["doc_id", "__hash", "__row"]  # the row tells equal keys apart, so a repeated id is split as well

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = worker_tokens(tokenizer_path, pieces_kept), TaskContext.get().partitionId()
        waiting, pieces, size, shard, before, nth = [], [], 0, 0, 0, 0  # pieces: (doc_id, nth, start, ids)

        def flush() -> pa.RecordBatch:
            counts = np.array([p[3] for p in pieces])
            g, symbols, each = compress(np.concatenate(waiting), np.cumsum(counts))
            lists = [[x] for x in map(list, zip(*pieces))]
            return batch(_SCHEMA, [part], [shard], [before], [size], *lists, [each.tolist()], [pack_shard(g, symbols)])

        for doc_ids, bodies in slices(batches, _TEXT_BYTES):
            ids, lengths = words.encode(bodies)
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, np.uint32(end_id))
            at = 0
            for i, n in zip(doc_ids, lengths + 1):
                n, start = int(n), 0
                while n:
                    k = min(n, shard_ids - size)
                    waiting.append(ids[at : at + k])
                    pieces.append((i, nth, start, k))
                    at, start, size, n = at + k, start + k, size + k, n - k
                    if size == shard_ids:
                        yield flush()
                        waiting, pieces, size, shard, before = [], [], 0, shard + 1, before + size
                nth += 1
        if size:
            yield flush()

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "body")
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(write, _TABLE).write.parquet(path)


def placed_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a table with base: the ids of all shards before. Sums are a row a part."""
    shards = spark.read.schema(_TABLE).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return shards.join(small_side(bases), shards["part"] == bases["__part"]).withColumn("base", F.col("__base") + F.col("before")).drop("__part", "__base")


def crc_joined(a: int, b: int, b_bytes: int) -> int:
    """The CRC-32 of two byte strings in a row from those of each: a's is moved on by b_bytes zero bytes (zlib's rule)."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # the operator of one zero bit
    n = 8 * b_bytes
    apply = lambda m, x: functools.reduce(lambda s, i: s ^ m[i] if x >> i & 1 else s, range(32), 0)
    while n:
        if n & 1:
            a = apply(step, a)
        n >>= 1
        step = [apply(step, x) for x in step]
    return a ^ b


def read_ids(spark: SparkSession, path: str, where: Column | None = None, begin: int = 0, end: int | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, nth, part, start, doc_start, n_ids, ids_crc32[, ids]): the pieces of documents, a row a shard that has one.

    start counts the ids of all documents before, doc_start those of the document before this piece. where: a condition
    on doc_id; shards without such a document are not decoded. begin, end: of each document the ids from begin up to end
    alone: by the expansion lengths just the symbols that hold them are expanded.
    """
    fields = [("doc_id", pa.int64()), ("nth", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("doc_start", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
    shards = placed_shards(spark, path)
    if where is not None:
        own = shards.select("part", "shard", F.posexplode("doc_ids").alias("__at", "doc_id")).where(where)
        own = own.groupBy("part", "shard").agg(F.collect_list("__at").alias("wanted"))
        shards = shards.join(own, ["part", "shard"])
    else:
        shards = shards.withColumn("wanted", F.lit(None).cast("array<int>"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {k: v[0] for k, v in b.slice(r, 1).to_pydict().items()}
                g, symbols = unpack_shard(row["data"])
                start, length, flat = g.expansions()
                lengths = length[symbols]
                filled = np.append(0, np.cumsum(lengths))
                every = np.append(0, np.cumsum(row["n_ids_each"]))
                out = []
                wanted = range(len(row["doc_ids"])) if row["wanted"] is None else sorted(row["wanted"])
                whole = row["wanted"] is None and begin == 0 and end is None
                ids = flat[gather_runs(start[symbols], lengths)].astype("<u4") if whole else None
                for d in wanted:
                    n, past = row["n_ids_each"][d], row["starts"][d]
                    low = min(n, max(0, begin - past))
                    high = n if end is None else max(low, min(n, end - past))
                    if whole:
                        x = ids[every[d] : every[d + 1]]
                    else:
                        s, e = np.searchsorted(filled, every[d] + low, side="right") - 1, np.searchsorted(filled, every[d] + high)
                        some = symbols[s : max(s, e)]
                        x = flat[gather_runs(start[some], length[some])].astype("<u4")[every[d] + low - filled[s] :][: high - low]
                    if len(x):
                        out.append((row["doc_ids"][d], row["nths"][d], row["part"], row["base"] + int(every[d]) - past, past + low, len(x), zlib.crc32(x.tobytes())) + ((x.tolist(),) if with_ids else ()))
                if out:
                    yield batch(schema, *zip(*out))

    ddl = "doc_id long, nth long, part int, start long, doc_start long, n_ids long, ids_crc32 long" + ", ids array<long>" * with_ids
    columns = ["part", "base", "doc_ids", "nths", "starts", "n_ids_each", "wanted", "data"]
    return shards.select(*columns).mapInArrow(decode, ddl)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; those of several shards are put together."""
    pieces = read_ids(spark, path, with_ids=False)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, s, parts in zip(*(c.to_pylist() for c in b.columns)):
                crc, total = parts[0]["ids_crc32"], parts[0]["n_ids"]
                for p in parts[1:]:
                    crc, total = crc_joined(crc, p["ids_crc32"], 4 * p["n_ids"]), total + p["n_ids"]
                out.append((i, s, total, crc))
            yield batch(schema, *zip(*out)) if out else batch(schema, [], [], [], [])

    ends = F.array_sort(F.collect_list(F.struct("doc_start", "n_ids", "ids_crc32")))
    grouped = pieces.groupBy("part", "nth").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), ends.alias("pieces"))
    return grouped.select("doc_id", "start", "pieces").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path(), end_id=2)
    return document_digests(spark, path)


QUERIES = {"op12_token_files": op12_token_files}
ORACLES: dict[str, str] = {}
