"""Operator 6: approximate nearest neighbours by additive quantisation.

BOOKS full-dimensional codebooks are fitted on a bounded sample (SAMPLE vectors in expectation) by residual k-means
and least squares; every vector is encoded by beam search over the residuals and indexed with its codes and the norm
of its reconstruction. Queries meet the candidates in blocks against blocks: lookup tables score a block's codes, and the
exact inner products of the SHORTLIST best, in doubles, say what a neighbour has to reach. Only candidates whose score
plus DEVIATIONS standard deviations of what their code leaves out reaches it are reranked exactly; the blocks' best are
merged. What a code leaves out has a length that is stored and a direction that the query does not know, so its product
with the query has the deviation |query| * error / sqrt(dimensions).
Equal vectors of a block are one candidate until the end, so that a hot vector fills no shortlist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normscape.llm.common import batch, saved

#: In a full block of random directions of 64 dimensions 6.4 % of the candidates are reranked with 16 books, 3.9 % with 20.
BOOKS, WORDS, BEAM = 20, 128, 4
SAMPLE = 6000
SHORTLIST = 128
#: A neighbour is lost if its product exceeds its score by more: some 3 in 100,000 of those right at the 20th place.
DEVIATIONS = 4.0
CANDIDATE_BLOCK, QUERY_BLOCK = 32_768, 4096


def usable(vector_col: str):
    """Neither null nor zero, without null or non-finite components."""
    v, bad = F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, lambda x: F.coalesce(bad(x), F.lit(True))) & F.exists(v, lambda x: x != 0)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * x @ words.T).argmin(1)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n x books) by beam search: the `beam` best partial sums of codewords go on from book to book."""
    n, dim = x.shape
    x, books = x.astype(np.float32), books.astype(np.float32)
    residual, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for words in books:
        kept = residual.shape[1]
        cost = (residual**2).sum(2)[:, :, None] - 2 * residual.reshape(-1, dim).dot(words.T).reshape(n, kept, -1) + (words**2).sum(1)
        flat = cost.reshape(n, -1)
        take = min(beam, flat.shape[1])
        best = np.argpartition(flat, take - 1, axis=1)[:, :take] if take < flat.shape[1] else np.tile(np.arange(take), (n, 1))
        parent, word = best // len(words), best % len(words)
        residual = np.take_along_axis(residual, parent[:, :, None], 1) - words[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[np.arange(n), (residual**2).sum(2).argmin(1)]


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Codebooks (books x words x dim): residual k-means, then one least-squares update of all codewords together."""
    rng = np.random.default_rng(seed)
    residual, out = sample.copy(), []
    for _ in range(books):
        w = residual[rng.choice(len(residual), words, replace=len(residual) < words)].copy()
        for _ in range(rounds):
            at = _nearest(residual, w)
            counts = np.bincount(at, minlength=words)
            sums = np.stack([np.bincount(at, residual[:, j], words) for j in range(residual.shape[1])], 1)
            w = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], w)
        residual = residual - w[_nearest(residual, w)]
        out.append(w)
    out = np.stack(out)
    codes = encode(sample, out)
    chosen = np.zeros((len(sample), books * words))
    chosen[np.arange(len(sample))[:, None], codes + np.arange(books) * words] = 1
    better = np.linalg.solve(chosen.T @ chosen + 1e-2 * np.eye(books * words), chosen.T @ sample + 1e-2 * out.reshape(books * words, -1))
    return better.reshape(out.shape)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, vector, codes, norm, error) of every usable vector as a saved() table, and the codebooks.

    Of rows that share an id the smallest vector counts; rows with a null id, and vectors that do not have the most
    common dimension (ties: the smaller), take no part. Other columns are left out, so names cannot clash.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        empty = rows.select("vec_id", F.lit(b"").alias("vector"), F.lit(b"").alias("codes"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("error"))
        return saved(empty, "index"), None
    dim, total = dims[0]
    rows = rows.where(F.size("v") == dim)
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total)))
    got = some.select("v").toPandas()["v"].tolist() or [r[0] for r in rows.select("v").limit(sample).collect()]
    books = fit(np.array(got))
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("codes", pa.binary()), ("norm", pa.float64()), ("error", pa.float64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                codes = encode(x, sent.value)
                made = sent.value[np.arange(len(sent.value)), codes].sum(1)
                yield batch(schema, part.column(0), [v.tobytes() for v in x], [c.tobytes() for c in codes], pa.array(np.linalg.norm(made, axis=1)), pa.array(np.linalg.norm(x - made, axis=1)))

    return saved(rows.mapInArrow(index, "vec_id long, vector binary, codes binary, norm double, error double"), "index"), books


def reach(query: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """By how much the exact product of a query may exceed the score of codes with these errors."""
    return np.linalg.norm(query) * errors * (DEVIATIONS / np.sqrt(len(query)))


def _stack(column: pd.Series, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def search(index: DataFrame, books: np.ndarray | None, queries: DataFrame, k: int = 20, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (rows of the index) its k nearest others by inner product."""
    spark = index.sparkSession
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(books)
    n_candidates = -(-index.count() // CANDIDATE_BLOCK) or 1
    n_queries = -(-queries.count() // QUERY_BLOCK) or 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    candidates = index.select("vec_id", "vector", "codes", "norm", "error", F.lit(False).alias("asks"), block(n_candidates).alias("c"), numbers(n_queries).alias("q"))
    asked = queries.select("vec_id", "vector", "codes", "norm", "error", F.lit(True).alias("asks"), numbers(n_candidates).alias("c"), block(n_queries).alias("q"))

    def near(group: pd.DataFrame) -> pd.DataFrame:
        books = sent.value
        mine, rest = group[group["asks"]], group[~group["asks"]].sort_values("vec_id")
        if not len(mine) or not len(rest):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        raw, ids = rest["vector"].to_numpy(), rest["vec_id"].to_numpy()
        _, first, inverse = np.unique(np.array([hash(v) for v in raw]), return_index=True, return_inverse=True)
        if any(raw[first[i]] != v for i, v in zip(inverse, raw)):  # unequal vectors with equal hashes
            _, first, inverse = np.unique(raw.astype("S"), return_index=True, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[order], np.arange(len(first) + 1))
        vectors, codes = _stack(rest["vector"].iloc[first], np.float64), _stack(rest["codes"].iloc[first], np.uint8)
        errors, largest = rest["error"].to_numpy()[first], rest["norm"].to_numpy()[first].max()
        asks, names = _stack(mine["vector"], np.float64), mine["vec_id"].to_numpy()
        out = []
        for s in range(0, len(asks), 32):
            q = asks[s : s + 32]
            tables = np.einsum("qd,bwd->qbw", q, books).astype(np.float32)
            score = sum(tables[:, b].take(codes[:, b], axis=1) for b in range(len(books)))
            take = min(shortlist, score.shape[1])
            best = np.argpartition(-score, take - 1, axis=1)[:, :take]
            exact = np.einsum("qrd,qd->qr", vectors[best], q)
            for name, own, at, value, quick in zip(names[s : s + 32], q, best, exact, score):
                cut = np.partition(value, -min(k + 1, take))[-min(k + 1, take)]
                if take < len(quick):  # scores are sums in single precision
                    more = quick + reach(own, errors) + 1e-4 * largest * np.linalg.norm(own) >= cut
                    more[at] = True
                    at = np.flatnonzero(more)
                    value = vectors[at] @ own
                    cut = np.partition(value, -(k + 1))[-(k + 1)]
                top = np.flatnonzero(value >= cut)
                members = [order[starts[r] : min(starts[r + 1], starts[r] + k + 1)] for r in at[top]]
                found = ids[np.concatenate(members)]
                values = np.repeat(value[top], [len(m) for m in members])
                other = found != name
                found, values = found[other], values[other]
                by = np.lexsort((found, -values))[:k]
                out.append((np.full(len(by), name), found[by], values[by]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})

    found = candidates.unionByName(asked).groupBy("c", "q").applyInPandas(near, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    index, books = build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(index, books, index.where("vec_id % 20 = 0"))


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
ORACLES: dict[str, str] = {}
