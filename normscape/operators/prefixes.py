"""Prefix trees of sequences by sorted neighbours: a shared prefix is a run of rows in sorted order.

Whole sequences are sorted into range partitions once. Between neighbours stands the number of words they share; from those
numbers alone a scan with a stack finds every node of the compressed tree (the runs, named by their first row and length)
and for each sequence the nodes on its way. Runs that reach over partitions are settled by what each partition leaves open:
the falling minima at its two edges, a few rows a partition, which are merged in one pass over the partitions. So words are
never rows, no join key is shared by all sequences, and a group of equal sequences may fill many partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType, NumericType, StructType

from normscape.sources.shared import delete, scratch, settled, small

#: Ends each word of a sequence written as one string; in a word it is escaped.
_END, _ESCAPE = "\x00", "\x01"
#: Rows and bytes of sequences in a range partition, on average: what a task's Python holds of them.
_ROWS, _BYTES = 20_000, 24 << 20
_NODES = "array<struct<pos: int, lo: long, token: string>>"


def _written(tokens: Column) -> Column:
    """A sequence as one string: every word with an end mark, so that shared words are a shared beginning; null words are empty."""
    words = F.when(F.array_join(tokens, "").rlike(f"[{_END}{_ESCAPE}]"), F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_END), F.lit(_ESCAPE + "a")))).otherwise(tokens)
    return F.when(F.size(tokens) > 0, F.concat(F.array_join(words, _END, ""), F.lit(_END))).otherwise("")


def written(tokens: Column) -> Column:
    """A sequence as the text that is sorted; numbers are written as text, null words are empty."""
    return _written(tokens.cast("array<string>"))


def _word(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").replace(_ESCAPE + "a", _END).replace(_ESCAPE + "b", _ESCAPE)


def shared(a: bytes, b: bytes) -> tuple[int, str | None, str | None]:
    """Words that two written sequences share from their beginning, and the next word of each."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # by halving, so that the comparisons are of whole slices
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    at = a.rfind(b"\x00", 0, low) + 1
    after = lambda x: _word(x[at : x.index(b"\x00", at)]) if at < len(x) else None
    return a.count(b"\x00", 0, at), after(a), after(b)


def _after(key: bytes, words: int) -> int:
    """Where a written sequence goes on after so many words."""
    at = 0
    for _ in range(words):
        at = key.index(b"\x00", at) + 1
    return at


def _ordered(rows: DataFrame, groups: list[str]) -> DataFrame:
    """rows in range partitions by groups and __key, sorted within them, with part: the partition's number; __key is binary."""
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("__key"))).first()
    parts = max(-(-n // _ROWS), -(-(size or 0) // _BYTES))
    order = [*groups, "__key", "__row"]
    # as many partitions as the input needs, however many there are by default, and fewer only of a small input; of groups
    # never more, as for each partition the driver gets some hundred keys, which are whole texts
    number = [max(parts, 1)] * (parts > 4 or bool(groups))
    ordered = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*number, *order).sortWithinPartitions(*order)
    return ordered.select(*[c for c in rows.columns if c != "__key"], F.spark_partition_id().alias("part"), F.col("__key").cast("binary").alias("__key"))


def _sorted(seqs: DataFrame, keep: list[str], with_rest: bool) -> DataFrame:
    """(part, at, n, lcp, left, right, edge[, rest], keep..): a row a sequence; lcp is null at a partition's first row.

    left and right: the words after the shared ones in the row before and in this one; edge: the written sequence of the
    partition's first and last row; rest: what follows the shared words.
    """
    if "__key" not in seqs.columns:  # sequences of nulls are left out
        seqs = seqs.where(F.col("tokens").isNotNull()).withColumn("__key", written(F.col("tokens")))
    ordered = _ordered(seqs.select(*[F.col(k).alias(f"c_{k}") for k in keep], "__key"), [])
    more = [("n", pa.int32()), ("lcp", pa.int32()), ("left", pa.string()), ("right", pa.string()), ("edge", pa.binary())] + [("rest", pa.binary())] * with_rest
    ddl = "part int, at long, n int, lcp int, left string, right string, edge binary" + ", rest binary" * with_rest

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting, at = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            columns = {name: [] for name, _ in more}
            for key in b.column("__key").to_pylist():
                lcp, left, right = shared(before, key) if before is not None else (None, None, None)
                out = [key.count(b"\x00"), lcp, left, right, key if before is None else None]
                if with_rest:
                    out.append(key[_after(key, lcp or 0) :])
                for (name, _), x in zip(more, out):
                    columns[name].append(x)
                before = key
            if waiting is not None:
                yield waiting.finish()
            waiting = _Waiting(b, columns, more, at)
            at += b.num_rows
        if waiting is not None:
            waiting.columns["edge"][-1] = before
            yield waiting.finish()

    schema = StructType([*ordered.select([f"c_{k}" for k in keep]).schema.fields, *StructType.fromDDL(ddl).fields])
    return ordered.mapInArrow(scan, schema)


class _Waiting:
    """A batch that is held until it is known whether its last row is the partition's last."""

    def __init__(self, batch: pa.RecordBatch, columns: dict, kinds: list, at: int):
        self.batch, self.columns, self.kinds, self.at = batch, columns, kinds, at

    def finish(self) -> pa.RecordBatch:
        b, n = self.batch, self.batch.num_rows
        given = {name: b.column(name) for name in b.schema.names if name.startswith("c_")}
        made = {name: pa.array(self.columns[name], kind) for name, kind in self.kinds}
        places = {"part": b.column("part"), "at": pa.array(range(self.at, self.at + n), pa.int64())}
        return pa.RecordBatch.from_pydict({**given, **places, **made})


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a partition leaves open: its falling minima from the left (side l) and to the right end (side r), its last stop."""
    pdf = pdf.sort_values("at")
    left, right, stop = [], [], None
    for at, n, lcp, before, after in zip(pdf["at"], pdf["n"], pdf["lcp"], pdf["left"], pdf["right"]):
        if lcp != lcp or lcp is None:
            stop = n
            continue
        lcp = int(lcp)
        if not left or lcp < left[-1][0]:
            left.append((lcp, int(at), before))
        while right and right[-1][0] >= lcp:
            right.pop()
        right.append((lcp, int(at), after))
        stop = stop if stop <= lcp else n
    out = [("l", *x) for x in left] + [("r", *x) for x in right] + [("s", int(stop), len(pdf), None)]
    return pd.DataFrame([(int(pdf["part"].iloc[0]), *x) for x in out], columns=["part", "side", "value", "at", "word"])


def _incoming(chains: pd.DataFrame, edges: dict[int, tuple]) -> list[tuple]:
    """(part, side, value, at, word) that each partition has to know of those before (l, and s: base and stop) and after (r).

    chains: of each partition's _chains(); edges: (shared words with the partition before, next word there, next word here).
    The work and the rows grow with the partitions times the minima open at their edges, not with the sequences.
    """
    parts = sorted(chains["part"].unique())
    own = {p: {s: [tuple(x) for x in g[["value", "at", "word"]].itertuples(index=False)] for s, g in c.groupby("side")} for p, c in chains.groupby("part")}
    out, stack, base, stop = [], [], 0, None
    bases = {}
    for p in parts:
        bases[p] = base
        out += [(int(p), "l", v, at, w) for v, at, w in stack]
        out.append((int(p), "s", -1 if stop is None else stop, base, None))
        if edges[p][0] is not None:
            stack = [x for x in stack if x[0] < edges[p][0]] + [(edges[p][0], base, edges[p][2])]
        ((last, rows, _),) = own[p]["s"]
        lows = own[p].get("l", [])
        least = min([x for x in (edges[p][0], lows[-1][0] if lows else None) if x is not None], default=None)
        if stop is None or least is not None and stop > least:
            # the stop from before is left at the first smaller number; what the partition itself says counts from there
            stop = last
        mine = own[p].get("r", [])
        if mine:
            stack = [x for x in stack if x[0] < mine[0][0]] + [(v, base + at, w) for v, at, w in mine]
        base += rows
    ahead: list[tuple] = []
    for p in reversed(parts):
        out += [(int(p), "r", v, 0, w) for v, _, w in ahead]
        if edges[p][0] is not None:
            mine = [(edges[p][0], 0, edges[p][1])] + own[p].get("l", [])
        else:
            mine = own[p].get("l", [])
        falling = []
        for v, at, w in mine:
            if not falling or v < falling[-1][0]:
                falling.append((v, at, w))
        # ahead rises: the smallest first
        ahead = [x for x in ahead if not falling or x[0] < falling[-1][0]] + [(v, 0, w) for v, _, w in reversed(falling)]
    return out


def paths(seqs: DataFrame, keep: tuple = ("traj_idx",), with_rest: bool = False) -> DataFrame:
    """(keep.., k, n, lcp, stop, nodes[, rest]): for each sequence its place k in sorted order and its nodes, root first.

    seqs: (keep.., tokens), or __key, which is written(), instead of tokens.

    A node is a prefix of pos words after which sequences part, or a whole sequence; lo is the first row that has it, and
    token the row's next word (null at its own end). stop: the length of the shortest sequence that is a prefix of this one
    (itself, if no other is), so that nodes with pos < stop have no ended sequence above them. lcp: the words shared with
    the row before. A row's nodes are as many as its partings. Null sequences have no row; equal ones have one each.
    """
    keep = list(keep)
    compact = settled(_sorted(seqs, keep, with_rest))
    chains = compact.select("part", "at", "n", "lcp", "left", "right").groupBy("part").applyInPandas(_chains, "part int, side string, value int, at long, word string").toPandas()
    last = F.max_by("edge", "at").alias("last")  # a row a partition from here on
    ends = compact.where(F.col("edge").isNotNull()).groupBy("part").agg(F.min_by("edge", "at").alias("first"), last)
    ends = ends.select("part", "first", F.lag("last").over(Window.orderBy("part")).alias("before"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            met = [(p, *(shared(b, f) if b is not None else (None, None, None))) for p, f, b in zip(pdf["part"], pdf["first"], pdf["before"])]
            yield pd.DataFrame(met, columns=["part", "lcp", "left", "right"])

    edges = {r["part"]: (r["lcp"], r["left"], r["right"]) for r in ends.mapInPandas(meet, "part int, lcp int, left string, right string").collect()}
    spark = seqs.sparkSession
    known = spark.createDataFrame([(*x, edges[x[0]][0], edges[x[0]][1], edges[x[0]][2]) for x in _incoming(chains, edges)], "part int, side string, value int, at long, word string, e_lcp int, e_left string, e_right string")
    given = [f"c_{k}" for k in keep] + ["rest"] * with_rest
    fields = ", ".join(f"`{c}` {compact.schema[c].dataType.simpleString()}" for c in given)

    def scan(rows: pa.Table, incoming: pa.Table) -> pa.Table:
        order = rows.column("at").to_numpy().argsort(kind="stable")
        rows = rows.take(pa.array(order))
        n, lcp, left, right = (rows.column(c).to_pylist() for c in ("n", "lcp", "left", "right"))
        told = incoming.to_pylist()
        lcp[0], left[0], right[0] = told[0]["e_lcp"], told[0]["e_left"], told[0]["e_right"]
        columns = {c: rows.column(c) for c in given}
        if with_rest and lcp[0]:
            whole = columns["rest"][0].as_py()
            first = pa.chunked_array([pa.array([whole[_after(whole, lcp[0]) :]], pa.binary())])
            columns["rest"] = pa.chunked_array([*first.chunks, *columns["rest"].slice(1).chunks], pa.binary())
        ((stop, base),) = [(t["value"], t["at"]) for t in told if t["side"] == "s"]
        # stacks are linked, so that each row keeps its own: (value, at, word, below)
        before = None
        for t in sorted((t for t in told if t["side"] == "l"), key=lambda t: t["value"]):
            before = (t["value"], t["at"], t["word"], before)
        after = None
        for t in sorted((t for t in told if t["side"] == "r"), key=lambda t: t["value"]):
            after = (t["value"], 0, t["word"], after)
        starts, stops = [], []
        for i, (size, v) in enumerate(zip(n, lcp)):
            if v is not None:
                while before is not None and before[0] >= v:
                    before = before[3]
                before = (v, base + i, right[i], before)
            stop = stop if v is not None and 0 <= stop <= v else size
            starts.append(before)
            stops.append(stop)
        nodes = [None] * len(n)
        for i in range(len(n) - 1, -1, -1):
            a, b, out = starts[i], after, []
            here = [(n[i], None)]  # (pos, next word), the longest first
            while a is not None or b is not None:
                if b is None or a is not None and a[0] >= b[0]:
                    pos, word = a[0], a[2]
                    b = b[3] if b is not None and b[0] == pos else b
                    a = a[3]
                else:
                    pos, word = b[0], b[2]
                    b = b[3]
                if pos < n[i]:
                    here.append((pos, word))
            a = starts[i]
            for pos, word in here:
                while a is not None and a[0] >= pos:
                    a = a[3]
                out.append({"pos": pos, "lo": a[1] if a is not None else 0, "token": word})
            nodes[i] = out[::-1]
            v = lcp[i]
            if v is not None:
                while after is not None and after[0] >= v:
                    after = after[3]
                after = (v, 0, left[i], after)
        made = [pa.array([base + i for i in range(len(n))], pa.int64()), pa.array(n, pa.int32()), pa.array(lcp, pa.int32()), pa.array(stops, pa.int32()), pa.array(nodes, pa.list_(pa.struct([("pos", pa.int32()), ("lo", pa.int64()), ("token", pa.string())])))]
        return pa.Table.from_arrays([*columns.values(), *made], names=[*given, "k", "n", "lcp", "stop", "nodes"])

    ddl = f"{fields}, k long, n int, lcp int, stop int, nodes {_NODES}"
    out = compact.select("part", "at", "n", "lcp", "left", "right", *given).groupBy("part").cogroup(known.groupBy("part")).applyInArrow(scan, ddl)
    rest = F.transform(F.split(F.regexp_replace(F.col("rest").cast("string"), f"{_END}$", ""), _END), lambda w: F.replace(F.replace(w, F.lit(_ESCAPE + "a"), F.lit(_END)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE)))
    shown = [F.col(f"c_{k}").alias(k) for k in keep] + ["k", "n", "lcp", "stop", "nodes"]
    return out.select(*shown, *[F.when(F.octet_length("rest") > 0, rest).otherwise(F.array().cast("array<string>")).alias("rest")] * with_rest)


#: Words from the beginning that tell most sequences from all others.
_HEAD = 16


def shortened(seqs: DataFrame) -> DataFrame:
    """(arm, __key): the arms' distinct sequences for paths(), those that part from all others in the first words cut there.

    A sequence whose first _HEAD words no other sequence has parts from the others within them, so all its nodes but its own
    end are there without the rest. Of equal sequences of an arm one is enough; they are known by 128 bits of hashes. So
    only near copies are sorted whole.
    """
    head = written(F.slice("tokens", 1, _HEAD))
    rows = seqs.where(F.col("tokens").isNotNull()).select("traj_idx", "arm", written(F.col("tokens")).alias("__key"), head.alias("__head"))
    rows = rows.select("*", F.xxhash64("__head").alias("__h"), F.xxhash64("__key").alias("__a"), F.xxhash64(F.lit(1), "__key").alias("__b"))
    # texts are split into words once, and all but the last reading leaves them in the file
    path = scratch(seqs.sparkSession, "sequences")
    try:
        rows.write.parquet(path)
        rows = seqs.sparkSession.read.schema(rows.schema).parquet(path)
        differ = (F.min("__a") < F.max("__a")) | (F.min("__b") < F.max("__b"))
        common = settled(rows.groupBy("__h").agg(differ.alias("__differ")).where("__differ").select("__h"))
        common = small(common, 500_000, 64 << 20)
        near = rows.join(common, "__h", "left_semi").groupBy("arm", "__a", "__b").agg(F.min("traj_idx").alias("traj_idx"))
        whole = rows.join(small(settled(near.select("traj_idx")), 500_000, 64 << 20), "traj_idx", "left_semi").select("arm", "__key")
        cut = rows.join(common, "__h", "left_anti").select("arm", F.col("__head").alias("__key")).distinct()
        return settled(cut.unionByName(whole))
    finally:
        delete(seqs.sparkSession, path)


def compressed(seqs: DataFrame, best: dict[str, Column] | None = None, walked: DataFrame | None = None) -> DataFrame:
    """(lo, pos, parent_lo, parent_pos, depth, n, is_leaf, is_end[, best..]): the nodes of the compressed tree, but the root.

    n: sequences through the node; is_end: one ends there; is_leaf: all do. depth counts nodes from the root, which is
    (0, 0) and has no row. best: aggregates of columns of seqs over the sequences through a node.
    """
    walked = paths(seqs, tuple(c for c in seqs.columns if c != "tokens")) if walked is None else walked
    steps = F.filter("nodes", lambda x: x["pos"] > 0)
    given = [c for c in walked.columns if c not in ("nodes", "rest")]
    rows = walked.select(*given, steps.alias("__s")).select(*given, "__s", F.posexplode("__s").alias("__i", "__x"))
    above = F.when(F.col("__i") > 0, F.get("__s", F.col("__i") - 1))
    rows = rows.select(*given, F.col("__x.lo").alias("lo"), F.col("__x.pos").alias("pos"), F.coalesce(above["lo"], F.lit(0)).alias("parent_lo"), F.coalesce(above["pos"], F.lit(0)).alias("parent_pos"), (F.col("__i") + 1).alias("depth"))
    own = [x.alias(k) for k, x in (best or {}).items()]
    return rows.groupBy("lo", "pos").agg(F.first("parent_lo").alias("parent_lo"), F.first("parent_pos").alias("parent_pos"), F.first("depth").alias("depth"), F.count("*").alias("n"), (F.max("n") == F.col("pos")).alias("is_leaf"), (F.min("n") == F.col("pos")).alias("is_end"), *own)


def node_id(lo: Column, pos: Column) -> Column:
    """A node as one number; rows up to 2 ** 39 and sequences of fewer than 2 ** 24 words have their own."""
    return F.shiftleft(lo.cast("long"), 24) + pos


#: What a walk adds up of sequences: whether it is a bundle, how many, the largest branch, the first that ends.
_Item = tuple[bool, int, tuple | None, tuple | None]


class _Walk:
    """The walk to the largest branch at each node, over the sequences of one group in sorted order.

    A stack has the nodes that are open: [pos, total, best, ended, word, left, right]. best is (count, word, answer) of the
    largest branch that is closed, ended the first answer of sequences that end there, word that of the branch at hand, left
    and right the words at the node's first parting. A closed branch is the item (False, total, None, answer), the closed
    branches of a node are a bundle: (True, total, best, ended). A branch has its word from the parting beside it.

    open: what comes before the first item is not known. Then nodes that reach it are not closed but left as items.
    """

    def __init__(self, item: _Item, order: Callable, open: bool):
        self.order, self.open, self.stack = order, open, []
        self.items = [(None, None, None, item)] if open else []
        self.at = None if open else item  # None: what is at hand is in items

    def _add(self, node: list, item: _Item, word: str | None) -> None:
        bundle, total, best, ended = item
        if not bundle and word is not None:
            best, ended = (total, word, ended), None
        node[1] += total
        if best is not None and (node[2] is None or best[0] > node[2][0] or best[0] == node[2][0] and self.order(best[1]) < self.order(node[2][1])):
            node[2] = best
        if ended is not None and (node[3] is None or _first(ended) < _first(node[3])):
            node[3] = ended

    def _close(self) -> None:
        node = self.stack.pop()
        self._add(node, self.at, node[4])
        if self.stack or not self.open:
            self.at = (False, node[1], None, node[2][2] if node[2] else node[3])
        else:
            self.items.append((node[0], node[5], node[6], (True, *node[1:4])))
            self.at = None

    def push(self, lcp: int, left: str | None, right: str | None, item: _Item) -> None:
        """The next item; it shares lcp words with the one before, and left and right are the next words of the two."""
        while self.stack and self.stack[-1][0] > lcp:
            self._close()
        if not self.stack or self.stack[-1][0] < lcp:
            self.stack.append([lcp, 0, None, None, left, left, right])
        if self.at is not None:
            self._add(self.stack[-1], self.at, self.stack[-1][4])
        self.stack[-1][4], self.at = right, item

    def closed(self) -> list[tuple]:
        """The whole group as one item, of a walk that is not open."""
        while self.stack:
            self._close()
        return [(None, None, None, self.at)]

    def rest(self) -> list[tuple]:
        """(lcp, left, right, item): what a later walk needs if this one's end, or what comes before it, is not known."""
        parting = (None, None, None)
        for i, (pos, total, best, ended, word, left, right) in enumerate(self.stack):
            known = not self.open or i > 0
            if known or total:
                self.items.append((*(parting if known else (pos, left, right)), (True, total, best, ended)))
            parting = (pos, None if known or total else left, word)
        if self.at is not None:
            self.items.append((*parting, self.at))
        return self.items


def _first(answer: tuple) -> tuple:
    """(-size, traj_idx) as it is ordered, nulls last."""
    return answer[0], answer[1] is None, answer[1]


def _order(kind: DataType) -> Callable:
    """Orders words of a kind that are written as text."""
    return int if isinstance(kind, IntegralType) else Decimal if isinstance(kind, DecimalType) else float if isinstance(kind, NumericType) else str


def open_walks(rows: DataFrame, kind: DataType) -> DataFrame:
    """Of each group the walk to the largest branch at each node, as far as range partitions know it, for joined_walks().

    rows: (group long, traj_idx, size int, __key), the last one written() words of this kind. A partition closes the nodes
    that lie within it, and has a few rows a node that reaches over its edges; a group within a partition is one row.
    """
    order, traj = _order(kind), rows.schema["traj_idx"].dataType.simpleString()
    ddl = "part int, i long, group long, lcp int, left string, right string, bundle boolean, total long, best long, word string, "
    ddl += f"best_size int, best_traj {traj}, ended_size int, ended_traj {traj}, edge binary"
    known = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [c.split(" ", 1) for c in ddl.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = group = before = begin = part = made = None
        schema = None

        def listed(items: list[tuple], begin: bytes | None, end: bytes | None) -> pa.RecordBatch:
            out = []
            for i, (lcp, left, right, (bundle, total, best, ended)) in enumerate(items):
                count, word, answer = best or (None, None, (None, None))
                edge = end if i == len(items) - 1 and end is not None else begin if i == 0 else None
                out.append((part, made + i, group, lcp, left, right, bundle, total, count, word, *answer, *(ended or (None, None)), edge))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            own = b.schema.field("traj_idx").type
            schema = pa.schema([(name, own if name.endswith("_traj") else known[k]) for name, k in kinds])
            for g, t, size, key, p in zip(*(b.column(c).to_pylist() for c in ("group", "traj_idx", "size", "__key", "part"))):
                item = (False, 1, None, (-size, t))
                if walk is None:
                    walk, group, part, begin, made = _Walk(item, order, True), g, p, key, 0
                elif g == group:
                    walk.push(*shared(before, key), item)
                else:
                    items = walk.rest() if walk.open else walk.closed()
                    yield listed(items, begin, None)
                    walk, group, begin, made = _Walk(item, order, False), g, None, made + len(items)
                before = key
        if walk is not None:
            yield listed(walk.rest(), begin, before)

    return _ordered(rows, ["group"]).mapInArrow(scan, ddl)


def joined_walks(walks: DataFrame, kind: DataType) -> DataFrame:
    """(group, traj_idx): where each group's walk ends, of settled open_walks().

    Sequences that end at a node drop out unless all do; of branches of one size the smallest word wins. Of sequences that are
    equal the one of the largest size is taken, then the smallest traj_idx. One task reads the walks in order, and holds no
    more than the nodes that are open.
    """
    order, traj = _order(kind), walks.schema["ended_traj"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = group = edge = own = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"group": pa.array([group], pa.int64()), "traj_idx": pa.array([walk.closed()[0][3][3][1]], own)})

        for b in batches:
            own = b.schema.field("ended_traj").type
            for r in b.to_pylist():
                best = (r["best"], r["word"], (r["best_size"], r["best_traj"])) if r["best"] is not None else None
                item = (r["bundle"], r["total"], best, (r["ended_size"], r["ended_traj"]) if r["ended_size"] is not None else None)
                if walk is not None and r["group"] == group:
                    walk.push(*((r["lcp"], r["left"], r["right"]) if r["lcp"] is not None else shared(edge, r["edge"])), item)
                else:
                    if walk is not None:
                        yield row()
                    walk, group = _Walk(item, order, False), r["group"]
                edge = r["edge"] if r["edge"] is not None else edge
        if walk is not None:
            yield row()

    return walks.coalesce(1).sortWithinPartitions("part", "i").mapInArrow(join, f"group long, traj_idx {traj}")
