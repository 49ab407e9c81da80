"""Operator 3: exact dedup by Patricia-trie owners.

Each scan task first collapses its own copies in a radix trie, so that a hot text leaves a task once; the distinct
texts are then partitioned by (length, content hash) and inserted, as full byte strings, into one compressed radix
trie a partition, whose terminal nodes hold the owner's id and the group's size. A trie over its memory bound spills
whole subtrees to the task's scratch folder and finishes them one by one. Owners are joined back by SHA-256, those of
very common texts by broadcast.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normscape.llm.common import batch, join_groups, saved, slices, text_rows

TRIE_BYTES = 48 << 20
_NODE_BYTES = 200


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def shared_prefix(key: bytes, at: int, edge: bytes) -> int:
    """How many bytes of edge equal key from at on, by halving slice comparisons."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key[at + low : at + mid] == edge[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("edge", "children", "count", "owner", "spilled")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.count, self.owner, self.spilled = edge, {}, 0, None, None


class RadixTrie:
    """Byte strings with an owner and a count each. Over limit bytes the largest subtree goes to a scratch file."""

    def __init__(self, choose: Callable, limit: int = TRIE_BYTES, folder: str | None = None):
        self.choose, self.limit, self.folder = choose, limit, folder
        self.root, self.size, self.texts, self.spills = Node(b""), 0, 0, 0

    def insert(self, key: bytes, owner: int | None, count: int) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                pickle.dump((key, owner, count), node.spilled)
                return
            if at == len(key):
                break
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(child.edge) + _NODE_BYTES
                node, at = child, len(key)
            elif key.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
            else:
                n = shared_prefix(key, at, child.edge)
                middle = Node(child.edge[:n])
                child.edge = child.edge[n:]
                middle.children[child.edge[0]] = child
                node.children[key[at]] = middle
                self.size += _NODE_BYTES
                node, at = middle, at + n
        node.owner = self.choose(node.owner, owner) if node.count else owner
        self.texts += not node.count
        node.count += count
        if self.folder is not None and self.size > self.limit and self.texts > 1:
            self._spill()

    def _walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        stack = [(node, prefix)]
        while stack:
            x, p = stack.pop()
            key = p + x.edge
            if x.count or x.spilled is not None:
                yield key, x
            stack += [(c, key) for c in x.children.values()]

    def _bytes(self, node) -> int:
        """Size of all nodes from this one down, inner ones included."""
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.edge) + _NODE_BYTES
            stack += x.children.values()
        return total

    def _spill(self) -> None:
        """Write the largest subtree below the first branching to a file; its node then only passes strings on."""
        top, prefix = self.root, b""
        while len(top.children) == 1 and not top.count:
            (child,) = top.children.values()
            if child.spilled is not None or not child.children:
                break
            prefix += top.edge
            top = child
        base = prefix + top.edge
        sizes = {k: self._bytes(c) for k, c in top.children.items() if c.spilled is None}
        if not sizes:
            return
        child = top.children[max(sizes, key=sizes.get)]
        out = tempfile.TemporaryFile(dir=self.folder)
        for key, node in self._walk(child, base):  # one string at a time: whole ones can be far longer than the trie
            if node.spilled is None:
                pickle.dump((key, node.owner, node.count), out)
            else:
                node.spilled.seek(0)
                for record in records(node.spilled):
                    pickle.dump(record, out)
        child.children, child.count, child.owner, child.spilled = {}, 0, None, out
        # the prefix of a spilled node is matched by its edge; strings ending inside it still split it
        self.size = self._bytes(self.root)
        self.texts = sum(1 for _, n in self._walk(self.root, b"") if n.count)
        self.spills += 1

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        for key, node in self._walk(self.root, b""):
            if node.spilled is None:
                yield key, node.owner, node.count
            else:
                node.spilled.seek(0)
                below = RadixTrie(self.choose, self.limit, self.folder)
                for record in records(node.spilled):
                    below.insert(*record)
                node.spilled.close()
                yield from below.items()


def records(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each input row.

    keep: `largest` or `smallest` id of equal texts stays. Null text counts as empty. A null id never owns a group
    that has another id. Rows that repeat an id are one document to `kept`: all or none of them stay. Other columns
    are left out, so names cannot clash; an empty table gives an empty result.
    """
    choose = {"largest": larger, "smallest": smaller}[keep]
    rows = text_rows(docs, id_col, text_col)
    parts_schema = pa.schema([("length", pa.int64()), ("content_hash", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
    owner_schema = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def emit(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for body, owner, n in trie.items():
            out.append((len(body), xxhash.xxh3_64_intdigest(body) - (1 << 63), owner, n, body))
            size += len(body)
            if size > 8 << 20:
                yield batch(parts_schema, *zip(*out))
                out, size = [], 0
        if out:
            yield batch(parts_schema, *zip(*out))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(choose)
        for ids, bodies in slices(batches):
            for i, body in zip(ids, bodies):
                trie.insert(body, i, 1)
            if trie.size > trie_bytes:
                yield from emit(trie)
                trie = RadixTrie(choose)
        yield from emit(trie)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            trie = RadixTrie(choose, trie_bytes, folder)
            for owners, counts, bodies in slices(batches):
                for owner, n, body in zip(owners, counts, bodies):
                    trie.insert(body, owner, n)
            out = []
            for body, owner, n in trie.items():
                out.append((hashlib.sha256(body).digest(), owner, n))
                if len(out) == 50_000:
                    yield batch(owner_schema, *zip(*out))
                    out = []
            if out:
                yield batch(owner_schema, *zip(*out))

    parts = rows.mapInArrow(collapse, "length long, content_hash long, owner long, n long, body binary")
    owners = parts.repartition("length", "content_hash").select("owner", "n", "body").mapInArrow(own, "sha binary, keep_id long, group_size long")
    owners = saved(owners, "owners")
    digests = rows.select("doc_id", F.unhex(F.sha2("body", 256)).alias("sha"))
    return join_groups(digests, owners, "sha", "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
}
