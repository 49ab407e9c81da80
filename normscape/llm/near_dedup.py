"""Operator 4: near-duplicates by b-bit MinHash.

1. One Python pass gives each document the number of its distinct word shingles, a 128-bit digest of its words,
   its band keys, and the low BITS bits of its minima packed into longs. Copies (same digest) become one class.
2. Star links: in each band bucket every class is paired with one centre, a different one in each band. The b-bit
   estimate, corrected for chance agreement, picks each class's most similar centre; that pair is confirmed on the
   full shingle sets, and confirmed links are contracted to components.
3. Buckets that still hold several components are compared in full, as blocks against blocks of signatures in numpy:
   first each block with itself, then, of buckets with several blocks, the different ones. Pairs of different
   components that the estimate does not rule out are candidates. They stay packed in one row a document; the task that
   gets a pair of blocks with its full sets checks them, likeliest first, joins what is linked as it goes, and emits
   only links that join two components.
So a large group of near copies costs links in proportion to its size, no row is made for a pair that is no link, and
no bucket, partner or candidate is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normscape.llm.common import WordCache, batch, hash_words, mix, saved, slices, small_side, temporary, text_rows
from normscape.llm.graph import components

HASHES, BITS = 128, 4
#: A pair at the threshold is in no common band with at most this probability.
MISS = 1e-6
#: Candidates go to the exact check unless their estimate is this many standard deviations below the threshold: a
#: pair at the threshold is ruled out with a probability of MISS at most.
MARGIN = 4.8
#: Documents, and bytes of full sets, of a block; signatures compared at once.
BLOCK, BLOCK_BYTES, PAIRS = 1024, 8 << 20, 1 << 15
_FIELDS = 64 // BITS
_SPREAD = (1 << 32) - 1


def bands_for(threshold: float, hashes: int = HASHES) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at the threshold with probability MISS or less."""
    for rows in range(hashes, 0, -1):
        if (1 - threshold**rows) ** (hashes // rows) <= MISS:
            return rows, hashes // rows
    return 1, hashes


def shingle_sets(texts: list[bytes], width: int, words: WordCache) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's sorted distinct shingle hashes, and the digest of its words (A-Z lower-cased)."""
    split = [t.lower().split() for t in texts]
    (hashes,) = words.look([w for s in split for w in s])
    sets, digests, at = [], [], 0
    for s in split:
        h = hashes[at : at + len(s)]
        at += len(s)
        digests.append(xxhash.xxh3_128_digest(h.tobytes()))
        n = min(width, len(s))
        if not n:
            sets.append(np.zeros(0, np.uint64))
            continue
        x = np.full(len(s) - n + 1, n, np.uint64)
        for j in range(n):
            x = mix(x + h[j : len(s) - n + 1 + j])
        sets.append(np.unique(x))
    return sets, digests


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each non-empty set, by xor-multiply permutations of the upper 32 bits."""
    rng = np.random.default_rng(20240229)
    xors, odds = rng.integers(0, _SPREAD, HASHES, np.uint32), rng.integers(0, _SPREAD, HASHES, np.uint32) | np.uint32(1)
    out = np.zeros((len(sets), HASHES), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 1 << 15):
            size += len(sets[last])
            last += 1
        x = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        x ^= x >> np.uint32(15)
        starts = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        for k in range(HASHES):
            y = (x ^ xors[k]) * odds[k]
            y ^= y >> np.uint32(16)
            out[first:last, k] = np.minimum.reduceat(y * odds[k - 1], starts)
        first = last
    return out


def pack_bits(minima_: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, _FIELDS to a 64-bit word."""
    low = (minima_ & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima_), HASHES // _FIELDS, _FIELDS)
    return np.bitwise_or.reduce(low << (np.arange(_FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many fields of packed signatures agree, by folding the differing bits and counting."""
    x = a ^ b
    for shift in (BITS // 2, BITS // 4):
        x = x | (x >> np.uint64(shift)) if shift else x
    ones = np.uint64(sum(1 << (i * BITS) for i in range(_FIELDS)))
    return HASHES - np.bitwise_count(x & ones).sum(-1, dtype=np.int64)


def least_agreeing(threshold: float) -> int:
    """Agreeing fields below which a pair at the threshold does not fall, but for MARGIN deviations of chance."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return max(0, math.floor(HASHES * p - MARGIN * math.sqrt(HASHES * p * (1 - p))))


def similarity(agree: Column) -> Column:
    """The estimate of the Jaccard similarity, corrected for fields that agree by chance."""
    chance = 2.0**-BITS
    return (agree / F.lit(float(HASHES)) - chance) / (1 - chance)


def signatures(docs: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, bands); the arrays are null where the set is empty."""
    rows, bands = bands_for(threshold)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache(hash_words)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for ids, texts in slices(batches):
            sets, digests = shingle_sets(texts, width, words)
            some = [s for s in sets if len(s)]
            low = minima(some)
            packed = pack_bits(low).astype(np.int64).tolist()
            keys = np.tile(salt, (len(some), 1))
            for r in range(rows):
                keys = mix(keys + low[:, r : rows * bands : rows].astype(np.uint64))
            keys = keys.astype(np.int64).tolist()
            full = iter(zip(packed, keys))
            pairs = [next(full) if len(s) else (None, None) for s in sets]
            yield batch(schema, ids, [len(s) for s in sets], digests, [p[0] for p in pairs], [p[1] for p in pairs])

    return text_rows(docs, id_col, text_col).mapInArrow(sign, "doc_id long, n_shingles long, digest binary, signature array<long>, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles) of the documents in wanted (doc_id, digest): the sorted shingle hashes as bytes.

    Of rows that share an id, those count whose text has the wanted digest.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache(hash_words)
        for ids, want, bodies in slices(batches):
            found = [(i, x.tobytes()) for i, w, x, d in zip(ids, want, *shingle_sets(bodies, width, words)) if d == bytes(w)]
            yield batch(schema, [f[0] for f in found], [f[1] for f in found])

    texts = text_rows(docs, id_col, text_col).join(small_side(wanted), "doc_id").select("doc_id", "digest", "body")
    return texts.mapInArrow(sets, "doc_id long, shingles binary")


def linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    common = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * common >= percent * (len(u) + len(v) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, x, y in slices(batches):
            keep = [linked(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), percent) for u, v in zip(x, y)]
            yield batch(schema, [i for i, k in zip(a, keep) if k], [i for i, k in zip(b, keep) if k])

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """A pair of blocks to a task, its rows together; as many tasks as shuffle partitions, for the work is in the pairs."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["bucket", "block_a", "block_b"]
    return rows.repartition(n, *key).sortWithinPartitions(*key).select(*key, *columns)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """((bucket, block_a, block_b), columns) of each run of rows; numbers and arrays of longs as numpy, bytes as lists."""
    held: list[list] = []

    def values(c: pa.Array):
        if pa.types.is_list(c.type):
            return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        return c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)

    def whole() -> tuple[tuple, list]:
        columns = [np.concatenate(x) if isinstance(x[0], np.ndarray) else sum(x, []) for x in zip(*held)]
        return tuple(int(c[0]) for c in columns[:3]), columns[3:]

    for b in batches:
        if not b.num_rows:
            continue
        columns = [values(c) for c in b.columns]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])) + 1
        if held and any(h[-1] != c[0] for h, c in zip(held[-1][:3], columns)):
            yield whole()
            held = []
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if start:
                yield whole()
                held = []
            held.append([c[start:end] for c in columns])
    if held:
        yield whole()


def _candidates(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """(bucket, block_a, block_b, doc_id, component, place, partners, agree): the documents of a pair of blocks that
    have a candidate there, with the places of their later partners and the fields that agree, as packed numbers.

    A pair counts in the first of the buckets that both are in, if the documents are of different components, may be
    linked by the sizes of their sets, and agree in at least `least` fields.
    """
    schema = pa.schema([("bucket", pa.int64()), ("block_a", pa.int32()), ("block_b", pa.int32()), ("doc_id", pa.int64()), ("component", pa.int64()), ("place", pa.int32()), ("partners", pa.binary()), ("agree", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (block, ids, comp, n, sig, bands) in groups(batches):
            sig = sig.astype(np.uint64)
            side_a, side_b = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            step, found = max(1, PAIRS // max(1, len(side_b))), []
            for s in range(0, len(side_a), step):
                a, b = np.repeat(side_a[s : s + step], len(side_b)), np.tile(side_b, len(side_a[s : s + step]))
                ok = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                if key[1] == key[2]:
                    ok &= a < b
                a, b = a[ok], b[ok]
                agree = agreeing(sig[a], sig[b])
                ok = agree >= least
                a, b, agree = a[ok], b[ok], agree[ok]
                first = (bands[a] == bands[b]).argmax(1)
                ok = bands[a, first] == key[0]
                found.append((a[ok], b[ok], agree[ok]))
            a, b, agree = map(np.concatenate, zip(*found))
            if not len(a):
                continue
            used = np.unique(np.append(a, b))
            place = np.zeros(len(ids), np.int32)
            place[used] = np.arange(len(used))
            order = np.argsort(place[a], kind="stable")
            cuts = np.searchsorted(place[a][order], np.arange(len(used) + 1))
            partners, agree = place[b][order], agree[order].astype(np.int16)
            parts = [x[i:j].tobytes() for x in (partners, agree) for i, j in zip(cuts[:-1], cuts[1:])]
            same = [np.full(len(used), k) for k in key]
            yield batch(schema, pa.array(same[0]), pa.array(same[1].astype(np.int32)), pa.array(same[2].astype(np.int32)), pa.array(ids[used]), pa.array(comp[used]), pa.array(np.arange(len(used), dtype=np.int32)), parts[: len(used)], parts[len(used) :])

    return dealt(rows, "block", "doc_id", "component", "n_shingles", "signature", "bands").mapInArrow(compare, "bucket long, block_a int, block_b int, doc_id long, component long, place int, partners binary, agree binary")


def _links(candidates: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found by checking the full sets of candidates, likeliest first, until they are of one component.

    A pair whose documents are already joined, by earlier rounds or in this task, needs no check. So a task emits
    fewer links than it has documents.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, comp, place, partners, agree, sets) in groups(batches):
            at = {int(p): k for k, p in enumerate(place)}  # a document that occurs twice in its table counts once
            counts = [len(partners[at[p]]) // 4 for p in range(len(at))]
            b = np.frombuffer(b"".join(partners[at[p]] for p in range(len(at))), np.int32)
            order = np.argsort(-np.frombuffer(b"".join(agree[at[p]] for p in range(len(at))), np.int16), kind="stable")
            a = np.repeat(np.arange(len(at)), counts)
            parent = {int(c): int(c) for c in comp}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            sets = [np.frombuffer(x, np.uint64) for x in sets]
            out = []
            for i, j in zip(a[order].tolist(), b[order].tolist()):
                i, j = at[i], at[j]
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y and linked(sets[i], sets[j], percent):
                    parent[max(x, y)] = min(x, y)
                    out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
            if out:
                yield batch(schema, *zip(*out))

    return dealt(candidates, "doc_id", "component", "place", "partners", "agree", "shingles").mapInArrow(verify, "a long, b long")


def _linked_classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved: signatures() of docs, the smallest id of each digest that several rows have, and the components (id, component)."""
    threshold = percent / 100
    least = least_agreeing(threshold)
    signed = saved(signatures(docs, width, threshold, id_col, text_col), "signatures")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = saved(some.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    first = some.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    first = saved(first.dropDuplicates(["doc_id"]), "first")

    bands = first.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    centre = F.min(F.struct(F.xxhash64("doc_id", "bucket").alias("h"), F.col("doc_id").alias("centre"))).alias("c")
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("size"), centre).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(8 * F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks")
    members = saved(bands.select("bucket", "doc_id").join(buckets.select("bucket", blocks, "c.centre"), "bucket"), "members")
    sig = first.select("doc_id", "n_shingles", "signature", "bands")
    wanted = saved(first.select("doc_id", "digest").join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "wanted")
    sets = saved(full_sets(docs, wanted, width, id_col, text_col), "sets")

    star = members.where("doc_id <> centre").select("doc_id", "centre").distinct()
    star = star.join(sig.drop("bands"), "doc_id").join(sig.select(F.col("doc_id").alias("centre"), F.col("n_shingles").alias("n2"), F.col("signature").alias("s2")), "centre")
    ones = sum(1 << (i * BITS) for i in range(_FIELDS)) - (1 << 64) * (BITS == 1)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (BITS // 2, BITS // 4):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift)) if shift else z
        return F.bit_count(z.bitwiseAND(F.lit(ones)))

    agree = F.lit(HASHES) - F.aggregate(F.zip_with("signature", "s2", differing), F.lit(0), lambda s, x: s + x)
    star = star.withColumn("agree", agree).where((F.col("agree") >= least) & (100 * F.least("n_shingles", "n2") >= percent * F.greatest("n_shingles", "n2")))
    best = star.groupBy("doc_id").agg(F.max(F.struct(similarity(F.col("agree")).alias("estimate"), (-F.col("centre")).alias("c"))).alias("m"))
    tried = best.select(F.least("doc_id", -F.col("m.c")).alias("a"), F.greatest("doc_id", -F.col("m.c")).alias("b")).distinct()
    links = saved(confirmed(tried, sets, percent), "links")
    joined = components(links)

    for own in (True, False):
        now = members.select("bucket", "blocks", "doc_id").where(F.lit(own) | (F.col("blocks") > 1))
        now = now.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        now = saved(now.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "residual")
        if not own and now.isEmpty():
            break
        key = ["bucket", "block"] if own else ["bucket"]
        open_ = now.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(*key)
        rows = now.join(open_, key)
        if own:
            rows = rows.withColumn("block_a", F.col("block")).withColumn("block_b", F.col("block"))
        else:
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
            rows = rows.withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other"))
        found = saved(_candidates(rows.join(sig, "doc_id"), least, percent), "candidates")
        more = saved(_links(found.join(sets, "doc_id"), percent), "links")
        if not more.isEmpty():
            links = saved(links.unionByName(more), "links")
            joined = components(links)

    return signed, saved(classes.where("copies > 1").drop("copies"), "repeated"), saved(joined, "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct `width`-word shingles
    (fewer words: all words as one shingle); component_id is the smallest id that a document reaches. Null, empty and
    blank texts have no shingle and link with nothing. A row with a null id names no document: it links with nothing,
    has no component_id and is kept. Repeated rows are the same document and each get its answer; of other texts under
    one id, one counts. Other columns are left out, so names cannot clash.
    """
    with temporary(docs.sparkSession, keep=("signatures", "repeated", "components")):
        signed, repeated, joined = _linked_classes(docs, id_col, text_col, width, percent)
    answer = signed.select("doc_id", "n_shingles", "digest").join(small_side(repeated), "digest", "left")
    answer = answer.withColumn("class_id", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "doc_id")))
    answer = answer.join(small_side(joined).withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return answer.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
ORACLES = {
    "op4_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y
  WHERE 100 * k >= 85 * (u.c + v.c - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (
  SELECT doc_id AS d, doc_id AS z FROM documents
  UNION
  SELECT r.d, b.y FROM r JOIN b ON b.x = r.z)
SELECT d AS doc_id, coalesce(any_value(n.c), 0)::BIGINT AS n_shingles, min(z) AS component_id, d = min(z) AS kept
FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""
}
