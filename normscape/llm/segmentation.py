"""Operator 10: sampled SentencePiece segmentations without replacement, and decoding.

The lattice of a text is that of its segments in a row (no piece reaches across a blank's front or a line end), so
a segment's lattice is worked out once a worker: for each position the pieces that start there and the probability
of each given the position. A top-down perturbed A* search over the lattice then emits the k segmentations with the
largest Gumbel-perturbed log-probabilities: a node's value is the largest below it, the chosen child takes it over,
and its siblings get Gumbels truncated at it. Nodes far down a path are first held as one lumped node, so the queue
stays short at any length of text, and the search stays exact. Completions are drawn for all segments of a slice at
once in numpy. All randomness is a hash of (seed, row key, sample, segment, step).
"""

from __future__ import annotations

import functools
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normscape.llm.common import Numbers, batch, gather_runs, mix, slices, text_rows

SAMPLES = 3
SEED = 17
#: Probability weights of pieces: exp(-SHARPNESS * ln(rank + 10)); a byte costs as much as the last piece.
SHARPNESS = 1.0
#: Segments whose lattices a worker holds; beyond that it forgets all and starts anew.
SEGMENT_CACHE = 200_000
#: Steps along a path whose siblings are queued at once; what is further down is one lumped node.
HORIZON = 6
_BLANK = "▁"
_FACTOR = 0x100000001B3
_GOLDEN = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


class Pieces:
    """The vocabulary: pieces, their weights, the bytes that each id decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte_id = {int(names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.ids = {names[i]: i for i in range(size) if not special[i] and not model.is_byte(i)}
        first = min(self.ids.values())
        self.byte_weight = -SHARPNESS * math.log(size + 10)
        self.weight = -SHARPNESS * np.log(np.maximum(np.arange(size) - first, 0) + 10.0)
        longest = max(map(len, self.ids))
        found: list[dict[int, int]] = [{} for _ in range(longest + 1)]
        for p, i in self.ids.items():
            h = 0
            for n, c in enumerate(p, 1):
                h = (h * _FACTOR + ord(c) + 1) & _ALL
                found[n][h] = i if n == len(p) else found[n].get(h, -1)
        #: for each length the sorted hashes of pieces and of their beginnings, with the piece's id or -1
        self.tables = [(np.array(sorted(d), np.uint64), np.array([d[h] for h in sorted(d)], np.int64)) for d in found]
        # neighbours that some piece holds: a text is cut between all others
        chars = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1,) * 2, bool)
        for p in self.ids:
            at = self.char[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        self.bytes = [b""] * size
        for p, i in self.ids.items():
            self.bytes[i] = p.replace(_BLANK, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self.byte_count = np.array(list(map(len, self.bytes)))
        self.byte_first = np.cumsum(self.byte_count) - self.byte_count
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the texts as the model sees them, lengths of their segments, and segments of each text.

        A text is cut between all neighbours that no piece holds.
        """
        seen = [_BLANK + t.replace(" ", _BLANK) if t else "" for t in texts]
        codes = np.frombuffer("".join(seen).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(list(map(len, seen)), dtype=np.int64)
        at = self.char[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.joined[at[:-1], at[1:]]
        begins[np.append(0, ends)[:-1][np.diff(ends, prepend=0) > 0]] = True
        starts = np.flatnonzero(begins)
        return codes, np.diff(np.append(starts, len(codes))), np.diff(np.searchsorted(starts, ends), prepend=0)

    def segments(self, text: str) -> list[str]:
        """The segments of one text."""
        codes, lengths, _ = self.cut([text])
        seen, ends = "".join(map(chr, codes)), np.cumsum(lengths).tolist()
        return [seen[i:j] for i, j in zip([0, *ends], ends)]

    def decode(self, ids) -> bytes:
        """UTF-8 bytes of the text; the blank put before every text is taken off again."""
        return b"".join(map(self.bytes.__getitem__, ids)).removeprefix(b" ")

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """decode() of each of the runs of ids, counts long, that follow one another."""
        sizes = self.byte_count[ids]
        flat = self.byte_flat[gather_runs(self.byte_first[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
        return [flat[i:j].removeprefix(b" ") for i, j in zip(ends[:-1], ends[1:])]


class Lattices:
    """Lattices of segments, in arrays over nodes (positions) and edges (pieces)."""

    def __init__(self, pieces: Pieces, cap: int = SEGMENT_CACHE):
        self.pieces, self.cap = pieces, cap
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.begin = np.zeros(0, np.int64)  # of each segment: its first node
        self.first = np.zeros(1, np.int64)  # of each node and one more: its first edge
        self.log_p, self.cumulative = np.zeros(0), np.zeros(0)
        self.target, self.node = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.id_first, self.id_count, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, np.int32)

    def nodes(self, segments: list[str]) -> np.ndarray:
        """The first node of each segment's lattice."""
        return self.at(np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32), np.array(list(map(len, segments)), np.int64))

    def at(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """nodes() of the segments of these lengths that follow one another in codes; 64-bit hashes name them."""
        if not len(lengths):
            return np.zeros(0, np.int64)
        if len(self.index) > self.cap:
            self.clear()
        starts = np.cumsum(lengths) - lengths
        within = np.arange(len(codes)) - np.repeat(starts, lengths)
        hashes = np.add.reduceat(mix(codes.astype(np.uint64) + within.astype(np.uint64) * np.uint64(_GOLDEN)), starts)
        own, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = len(self.index)
        numbers = np.fromiter(map(self.index.__getitem__, own.tolist()), np.int64, len(own))
        self.index.new = []
        new = where[numbers >= known]
        if len(new):
            self._add(codes[gather_runs(starts[new], lengths[new])].astype(np.uint64), lengths[new])
        return self.begin[numbers[back]]

    def _add(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        pieces, base, edges = self.pieces, len(self.first) - 1, len(self.log_p)
        ends = np.cumsum(lengths)
        self.begin = np.append(self.begin, base + ends - lengths)
        left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters up to the segment's end
        active, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        single = np.zeros(len(codes), bool)
        for n in range(1, len(pieces.tables)):
            fits = left[active] >= n
            active, h = active[fits], h[fits] * np.uint64(_FACTOR) + codes[active[fits] + n - 1] + np.uint64(1)
            hashes, values = pieces.tables[n]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[at] == h
            active, h, value = active[known], h[known], values[at[known]]
            whole = value >= 0
            found.append((active[whole], np.full(int(whole.sum()), n), value[whole]))
            if n == 1:
                single[active[whole]] = True
        lone = np.flatnonzero(~single)  # characters without a piece: their bytes
        spelt = [[pieces.byte_id[b] for b in chr(int(codes[i])).encode("utf-8", "replace")] for i in lone]
        found.append((lone, np.ones(len(lone), np.int64), -1 - np.arange(len(lone))))
        source, length, piece = (np.concatenate(x) for x in zip(*reversed(found)))
        order = np.argsort(source, kind="stable")  # longer pieces first
        source, length, piece = source[order], length[order], piece[order]
        bytes_of = np.array([len(x) for x in spelt] or [0])
        own = piece >= 0
        weight = np.where(own, pieces.weight[np.maximum(piece, 0)], bytes_of[np.where(own, 0, -1 - piece)] * pieces.byte_weight)
        target, last = source + length, length == left[source]
        # sums over all ways to the segment's end, from its last character to its first
        beta = np.zeros(len(codes) + 1)
        by = np.argsort(left[source], kind="stable")
        turns = np.flatnonzero(np.append(True, np.diff(left[source][by]) > 0))
        for e in np.split(by, turns[1:]):
            begin = np.flatnonzero(np.append(True, source[e][1:] != source[e][:-1]))
            beta[source[e][begin]] = np.logaddexp.reduceat(weight[e] + np.where(last[e], 0.0, beta[target[e]]), begin)
        log_p = weight + np.where(last, 0.0, beta[target]) - beta[source]
        begin = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        total = np.cumsum(np.exp(log_p))
        cumulative = total - np.repeat(np.append(0.0, total[begin[1:] - 1]), np.diff(np.append(begin, len(source))))
        cumulative[np.append(begin[1:], len(source)) - 1] = 2.0  # the last edge takes what rounding leaves
        counts = np.where(own, 1, bytes_of[np.where(own, 0, -1 - piece)])
        flat = np.repeat(piece, counts)
        flat[flat < 0] = [i for p in piece[~own] for i in spelt[-1 - p]]
        self.first = np.concatenate([self.first[:-1], edges + begin, [edges + len(source)]])
        self.log_p, self.cumulative = np.append(self.log_p, log_p), np.append(self.cumulative, cumulative)
        self.target = np.append(self.target, np.where(last, -1, base + target).astype(np.int32))
        self.node = np.append(self.node, (base + source).astype(np.int32))
        self.id_first = np.append(self.id_first, (len(self.flat) + np.cumsum(counts) - counts).astype(np.int32))
        self.id_count, self.flat = np.append(self.id_count, counts.astype(np.int16)), np.append(self.flat, flat.astype(np.int32))

    def choose(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node by inverse probability."""
        edge = self.first[nodes]
        more = np.flatnonzero(u >= self.cumulative[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= self.cumulative[edge[more]]]
        return edge

    def draw(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a random path through each segment's lattice, in order, and where each segment's edges begin."""
        active, at, steps, step = np.arange(len(nodes)), nodes, [], 0
        while len(active):
            u = (mix(keys[active] + np.uint64(step * _GOLDEN & _ALL)) >> np.uint64(11)) * 2.0**-53
            edge = self.choose(at, u)
            steps.append((active, edge))
            at = self.target[edge]
            going = at >= 0
            active, at, step = active[going], at[going], step + 1
        counts = np.zeros(len(nodes), np.int64)
        for a, _ in steps:
            counts[a] += 1
        begin = np.append(0, np.cumsum(counts))
        out = np.empty(begin[-1], np.int64)
        for i, (a, edge) in enumerate(steps):
            out[begin[a] + i] = edge
        return out, begin

    def ids(self, edges: np.ndarray) -> np.ndarray:
        return self.flat[gather_runs(self.id_first[edges].astype(np.int64), self.id_count[edges].astype(np.int64))]


def truncated(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at the locations, given that they are at most `most`."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-most, np.log(-np.log(u)) - location)


class Search:
    """The A* searches of many texts, one step of each at a time, so that numpy works on all texts at once.

    A text's queue holds nodes (path, depth, edge, prefix): the segmentations that share the path's first edges and
    then take another one; with edge -1, all that leave the path from depth on. A node's value is the largest below
    it, so nodes with k larger values beside them can be left out of the queue.
    """

    def __init__(self, lattices: Lattices, draws: list, begins: np.ndarray, ends: np.ndarray, k: int, keys: np.ndarray, horizon: int = HORIZON):
        self.lat, self.draws, self.begins, self.ends, self.k, self.horizon = lattices, draws, begins, ends, k, horizon
        self.state, self.made = keys.astype(np.uint64), 0
        n = len(keys)
        self.paths: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.suffixes: list[list[np.ndarray]] = [[] for _ in range(n)]  # log-probability of a path from each edge on
        self.found: list[list[tuple]] = [[] for _ in range(n)]
        self.queues: list[list[tuple]] = [[] for _ in range(n)]

    def uniforms(self, texts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Values in (0, 1), counts of them from each text's own stream; a text occurs once in texts."""
        self.state[texts] += np.uint64(_GOLDEN)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        x = mix(np.repeat(self.state[texts], counts) + within.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        return ((x >> np.uint64(11)) + np.uint64(1)) * (2.0**-53 * (1 - 2.0**-52))

    def add(self, text: int, path: np.ndarray, value: float) -> None:
        suffix = self.lat.log_p[path][::-1].cumsum()[::-1]
        self.paths[text].append(path)
        self.suffixes[text].append(suffix)
        self.found[text].append((path, float(suffix[0]) if len(path) else 0.0, value))

    def run(self) -> list[tuple[list, float]]:
        """For each text its k best (edges, log_p, value), and the value of the next."""
        every = np.arange(len(self.paths))
        values = -np.log(-np.log(self.uniforms(every, np.ones(len(every), np.int64))))
        edges, cuts = self.draws[0]
        for t, (i, j, v) in enumerate(zip(cuts[self.begins].tolist(), cuts[self.ends].tolist(), values.tolist())):
            self.add(t, edges[i:j], v)
        asked = [(t, 0, 0, 0.0, v, False) for t, v in enumerate(values.tolist()) if len(self.paths[t][0])]
        active = [a[0] for a in asked]
        while asked:
            self.expand(asked)
            asked, chosen, going = [], [], []
            for t in active:
                if self.queues[t] and len(self.found[t]) < self.k:
                    value, _, path, depth, edge, prefix = heapq.heappop(self.queues[t])
                    going.append(t)
                    if edge < 0:
                        asked.append((t, path, depth, prefix, -value, True))
                    else:
                        chosen.append((t, path, depth, edge, prefix, -value))
            active = going
            if chosen:
                asked += self.complete(chosen)
        return [(f, -q[0][0] if q else -math.inf) for f, q in zip(self.found, self.queues)]

    def complete(self, chosen: list[tuple]) -> list[tuple]:
        """Draw a path through each chosen node: the rest of its segment anew, later segments as drawn before."""
        lat, texts = self.lat, np.array([c[0] for c in chosen])
        own = [[c[3]] for c in chosen]
        at, rest = lat.target[[c[3] for c in chosen]], np.arange(len(chosen))
        while len(rest := rest[at >= 0]):
            edge = lat.choose(at[at >= 0], self.uniforms(texts[rest], np.ones(len(rest), np.int64)))
            for r, e in zip(rest.tolist(), edge.tolist()):
                own[r].append(e)
            at = lat.target[edge]
        asked = []
        for (t, path, depth, edge, prefix, value), mine in zip(chosen, own):
            head = self.paths[t][path][:depth]
            segment = int(self.begins[t]) + int((lat.target[head] < 0).sum()) + 1
            edges, cuts = self.draws[len(self.found[t])]
            self.add(t, np.concatenate([head, np.array(mine, np.int64), edges[cuts[segment] : cuts[self.ends[t]]]]), value)
            asked.append((t, len(self.paths[t]) - 1, depth + 1, prefix + float(lat.log_p[edge]), value, False))
        return asked

    def expand(self, asked: list[tuple]) -> None:
        """Queue what leaves the asked paths in their next `horizon` steps, and one node for all that leaves later.

        Of a node that stood for all (the last flag), the largest value must occur again: Gumbels choose where.
        """
        lat, horizon, n = self.lat, self.horizon, len(asked)
        texts, path, depth, prefix, most, lumped = (np.array(x) for x in zip(*asked))
        own = [self.paths[t][p][d : d + horizon] for t, p, d, *_ in asked]
        size = np.array(list(map(len, own)))
        steps, starts = np.concatenate(own), np.cumsum(size) - size
        request, log_p = np.repeat(np.arange(n), size), lat.log_p[steps]
        before = np.append(np.cumsum(log_p) - log_p, log_p.sum())
        before = before[:-1] - before[starts][request] + prefix[request]
        node = lat.node[steps]
        first = lat.first[node]
        count = lat.first[node + 1] - first
        edge, at = gather_runs(first, count), np.repeat(np.arange(len(steps)), count)
        other = edge != steps[at]
        edge, at = edge[other], at[other]
        tails = np.array([s[d + horizon] if d + horizon < len(s := self.suffixes[t][p]) else 0.0 for t, p, d, *_ in asked])
        more = np.flatnonzero(tails < 0)
        last = starts[more] + size[more] - 1
        reached = before[last] + log_p[last]
        which = np.append(request[at], more)
        order = np.argsort(which, kind="stable")
        which = which[order]
        where = np.append(before[at] + lat.log_p[edge], reached + np.where(tails[more] > -30, np.log(-np.expm1(np.maximum(tails[more], -30))), 0.0))[order]
        if not len(where):
            return
        edge, prefixes = np.append(edge, np.full(len(more), -1))[order], np.append(before[at], reached)[order]
        depths = np.append(depth[request[at]] + at - starts[request[at]], depth[more] + horizon)[order]
        counts = np.bincount(which, minlength=n)
        u = self.uniforms(texts, counts)
        values = truncated(where, most[which], u)
        again = np.flatnonzero(lumped)
        if len(again):
            inside = lumped[which]
            noise = np.where(inside, where - np.log(-np.log(u)), -np.inf)
            values[inside] = truncated(where[inside], most[which[inside]], self.uniforms(texts[again], counts[again]))
            by = np.lexsort((-noise, which))
            winners = by[(np.cumsum(counts) - counts)[again]]
            values[winners] = most[again]
        by = np.lexsort((-values, which))
        rank = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
        room = self.k + 1 - np.array([len(self.found[t]) for t, *_ in asked])
        by = by[rank < room[which[by]]]
        r = which[by]
        for t, p, v, d, e, x in zip(texts[r].tolist(), path[r].tolist(), values[by].tolist(), depths[by].tolist(), edge[by].tolist(), prefixes[by].tolist()):
            self.made += 1
            heapq.heappush(self.queues[t], (-v, self.made, p, d, e, x))


def search(lattices: Lattices, draws: list, first: int, last: int, k: int, key: int, horizon: int = HORIZON) -> tuple[list, float]:
    """Search for one text, whose segments are [first, last) of the draws."""
    return Search(lattices, draws, np.array([first]), np.array([last]), k, np.array([key], np.uint64), horizon).run()[0]


def log_inclusion(log_p: float, threshold: float) -> float:
    """Log-probability that a segmentation's perturbed value passes the threshold: its inclusion score."""
    x = log_p - threshold
    return x if x < -30 else 0.0 if x > 5 else math.log(-math.expm1(-math.exp(x)))


@functools.lru_cache(maxsize=1)
def worker_lattices(model_path: str) -> Lattices:
    """One for a Python worker: what a task has worked out serves the next."""
    return Lattices(Pieces(model_path))


def sample(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = SEED, with_ids: bool = False, horizon: int = HORIZON) -> DataFrame:
    """(doc_id, sample, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, round_trip[, ids]).

    Up to k distinct segmentations of each text, the largest perturbed value first (sample 1..k; fewer if the text
    has fewer). Null and empty texts have one, without pieces. The row key is doc_id: repeated rows repeat their
    samples; null ids share a key. Other columns are left out, so names cannot clash.
    """
    fields = [("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_())]
    ddl = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean" + ", ids array<long>" * with_ids
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = worker_lattices(model_path)
        pieces = lat.pieces
        for ids, bodies in slices(batches):
            texts = [b.decode("utf-8", "replace") for b in bodies]
            codes, lengths, counts = pieces.cut(texts)
            nodes = lat.at(codes, lengths)
            keys = mix(np.array([0 if i is None else i for i in ids], np.int64).astype(np.uint64) + np.uint64(seed * _GOLDEN & _ALL))
            ends = np.cumsum(counts)
            within = np.arange(len(nodes), dtype=np.uint64) - np.repeat(ends - counts, counts).astype(np.uint64)
            own = mix(np.repeat(keys, counts) + within * np.uint64(0xBF58476D1CE4E5B9))
            draws = [lat.draw(nodes, mix(own + np.uint64(t + 1))) for t in range(k)]
            found = Search(lat, draws, ends - counts, ends, k, keys, horizon).run()
            samples = [(i, rank, log_p, value, threshold) for i, (best, threshold) in enumerate(found) for rank, (_, log_p, value) in enumerate(best, 1)]
            paths = [edges for best, _ in found for edges, *_ in best]
            edges = np.concatenate(paths)
            flat = lat.ids(edges)
            cuts = np.append(0, np.cumsum(lat.id_count[edges], dtype=np.int64))[np.append(0, np.cumsum(list(map(len, paths))))]
            decoded, packed, cuts = pieces.decode_all(flat, np.diff(cuts)), flat.astype("<u4"), cuts.tolist()
            out = []
            for (i, rank, log_p, value, threshold), made, start, end in zip(samples, decoded, cuts[:-1], cuts[1:]):
                row = (ids[i], rank, end - start, zlib.crc32(packed[start:end]), log_p, value, log_inclusion(log_p, threshold), made == bodies[i])
                out.append(row + ((flat[start:end].tolist(),) if with_ids else ()))
            yield batch(schema, *zip(*out))

    return text_rows(docs, id_col, text_col).mapInArrow(segment, ddl)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """rows with the text of their ids; null ids give null text. A column named out_col is replaced."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(model_path)
        for b in batches:
            yield b.map(lambda ids: None if ids is None else pieces.decode(list(ids)).decode("utf-8", "replace"))

    return rows.withColumn(out_col, text(F.col(ids_col)))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    return sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_model_path())


QUERIES = {"op10_sentencepiece_sampling": op10_sentencepiece_sampling}
ORACLES: dict[str, str] = {}
