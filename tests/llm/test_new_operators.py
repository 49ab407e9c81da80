"""Operators 11 to 13: brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from normscape.llm import language_model, merkle, packing, periodic_runs, token_files
from normscape.llm.cover_lce import CoverLCE
from tests.llm.test_llm import HARD, SF


@pytest.fixture(scope="module")
def hard(spark):
    columns = "doc_id long, text string, n_chars long, source string, lang string, leaf string, `group` int, runs int, part int, start int, node string, tree int"
    return spark.createDataFrame([(i, t, None if t is None else len(t), None if k % 3 == 0 else f"s{k % 2}", "en", "x", 1, 2, 3, 4, "y", 5) for k, (i, t) in enumerate(HARD)], columns)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# operator 11


def brute_manifest(rows, forge):
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    leaf = lambda r: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[k] for k in merkle.FIELDS)])

    def climb(nodes):
        """The root, and for each node (left, right) of every level above it."""
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(where):
                s = i - i % 3
                paths[k].append((nodes[s:i], nodes[i + 1 : s + 3]))
                where[k] = i // 3
            nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        return nodes[0], paths

    null_first = lambda x: (x is not None, x if x is not None else 0)
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (null_first(r["doc_id"]), leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            cur = leaf(forge(r))
            for left, right in path + top:
                cur = h(*left, cur, *right)
            proof = h(*[x for left, right in path + top for x in left + right])
            out.append((r["doc_id"], leaf(r), subroot, root, proof, cur, cur == root))
    return out


def forged(r):
    even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
    return r | {"text": r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]}


def test_manifest_against_brute_force(spark, hard, tmp_path):
    some = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    # a source of more than one superblock of superblocks is too large for a test; three levels of superblocks of one level are not
    many = [dict(doc_id=i // 2, source="hot" if i % 3 else f"t{i % 7}", lang=None, n_chars=i, text=f"a\n{i // 5}") for i in range(2000)]
    for k, rows in enumerate((some, [r.asDict() for r in hard.select(*merkle.FIELDS).collect()], many)):
        path = f"{tmp_path}/{k}"
        spark.createDataFrame([tuple(r[f] for f in merkle.FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{path}/documents.parquet")
        got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, path).collect()]
        assert sorted(got, key=str) == sorted(brute_manifest(rows, forged), key=str)


def test_manifest_of_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = [dict(doc_id=i, source=f"s{i % 5}" if i < 20 else None if i == 20 else "hot", lang="en", n_chars=i, text=f"t\n{i}") for i in range(100)]
    docs = spark.createDataFrame([tuple(r[f] for f in merkle.FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    nodes = merkle.numbered(merkle.saved(docs.select(docs["source"].alias("group"), "doc_id", F.col("text").alias("node")), "t"), ["doc_id"]).select("tree", "rank", "size", "doc_id").collect()
    ids = lambda s: [r["doc_id"] for r in rows if r["source"] == s]
    want = [(t, k, len(ids(s)), i) for t, s in enumerate([None, "hot", "s0", "s1", "s2", "s3", "s4"]) for k, i in enumerate(ids(s))]
    assert sorted(map(tuple, nodes)) == want
    assert merkle.reduced(["a", "b", "c", "d"], 4) == [["a", "b", "c", "d"], [merkle.digest("abc"), merkle.digest("d")]]
    levels = merkle.reduced([str(i) for i in range(3)], 3)
    assert [merkle.folded(str(i), merkle.sides(levels, i)) for i in range(3)] == [levels[-1][0]] * 3


def test_manifest_of_nothing_and_one(spark, hard):
    assert merkle.manifest(hard.limit(0)).count() == 0
    (one,) = merkle.manifest(hard.where("doc_id = 8")).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    long = spark.createDataFrame([(1, "s", None, 5, "é\n" * 1_500_000), (2, "s", None, 5, "b")], "doc_id long, source string, lang string, n_chars long, text string")
    leaves = {r["doc_id"]: r["leaf"] for r in merkle.manifest(long).collect()}
    assert leaves[1] == hashlib.sha256(("1:11:s-1:54500000:" + "é\n" * 1_500_000).encode()).hexdigest()


# operator 12


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(token_files.tokenizer_path()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_against_the_library(spark, documents):
    got = token_files.op12_token_files(spark, SF).collect()
    assert sorted(map(tuple, got)) == brute_tokens(documents.items())


@pytest.mark.parametrize("shard_ids", [7, 100, token_files.SHARD_IDS])
def test_token_files_of_hard_texts(spark, hard, tmp_path, shard_ids):
    odd = ["a\n\nb \n c", "x<|endoftext|> y", "it's 12,5 été, naïve×2", "…  …  x  y", "a a a a a a a a " * 30]
    docs = hard.select("doc_id", "text", "part", "start").unionByName(spark.createDataFrame([(100 + k, t, 0, 0) for k, t in enumerate(odd)], "doc_id long, text string, part int, start int"))
    path = f"{tmp_path}/ids"
    token_files.write_ids(docs, path, token_files.tokenizer_path(), 2, shard_ids=shard_ids)
    want = brute_tokens(HARD + [(100 + k, t) for k, t in enumerate(odd)])
    got = sorted(map(tuple, token_files.document_digests(spark, path).collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    assert got == want
    # whole ids, and a stretch of one document by its place
    ids = {}
    for r in sorted(token_files.read_ids(spark, path).collect(), key=lambda r: (r["part"], r["nth"], r["doc_start"])):
        ids.setdefault(r["start"], []).extend(r["ids"])
    assert {s: len(x) for s, x in ids.items()} == {s: n for _, s, n, _ in want}
    (start,) = [s for i, s, *_ in want if i == 104]
    some = token_files.read_ids(spark, path, F.col("doc_id") == 104, 5, 40).orderBy("doc_start").collect()
    assert sum([r["ids"] for r in some], []) == ids[start][5:40] and some[0]["doc_start"] == 5
    token_files.write_ids(docs.limit(0), f"{tmp_path}/none", token_files.tokenizer_path(), 2)
    assert token_files.document_digests(spark, f"{tmp_path}/none").count() == 0


def test_pieces_of_any_text():
    words = token_files.ByteTokens(token_files.tokenizer_path(), cap=300)
    rng = random.Random(1)
    parts = [" ", "\n", "  ", "a", "The", "'s", "é", " ", "1", "!", "\t", " ", "日", "\r", " x", "×", "ß", "\x7f", "<|endoftext|>"]
    for _ in range(1500):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3)]
        ids, n = words.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_grammar_round_trip_and_size():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n = int(rng.integers(1, 3000))
        ids = rng.integers(0, rng.integers(1, 6), n).astype(np.uint32)
        if trial % 2:
            ids = np.tile(ids[: max(1, n // 9)], 12)[:n]
        ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 3), len(ids)))
        g, symbols, each = token_files.compress(ids, ends)
        g, symbols = token_files.unpack_shard(token_files.pack_shard(g, symbols))
        start, length, flat = g.expansions()
        assert (flat[token_files.gather_runs(start[symbols], length[symbols])] == ids).all()
        assert (np.append(0, np.cumsum(length[symbols]))[np.cumsum(each)] == ends).all()  # no rule reaches over an end
    repeated = np.tile(rng.integers(0, 50000, 500), 64).astype(np.uint32)
    assert len(token_files.pack_shard(*token_files.compress(repeated, np.array([len(repeated)]))[:2])) < len(repeated) // 2
    for a, b in ((b"", b"xyz"), (b"abc", b""), (b"hello ", b"world" * 999)):
        assert token_files.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    with pytest.raises(ValueError):
        token_files.unpack_shard(b"nope")


# operator 13


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q - s), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    runs = brute_runs(w)
    gone = {j for s, length, q in runs for j in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def test_runs_against_brute_force(spark, hard, documents, tmp_path):
    short = {i: t for i, t in documents.items() if len(t or "") < 9000}
    rows = [(i, t) for i, t in short.items()] + [(1000 + k, "a b " * k + "c " * (k % 9) + " ".join("xyx"[j % 3] for j in range(3 * k))) for k in range(40)] + HARD
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(i, t) for i, t in rows), key=str)


def test_runs_of_streams(spark, hard):
    rng = np.random.default_rng(3)
    for _ in range(80):
        docs = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 90))
            w = [b"abcdef"[x : x + 1] for x in rng.integers(0, rng.integers(1, 5), n)]
            a, p = int(rng.integers(0, n + 1)), int(rng.integers(1, n // 4 + 2))
            docs.append([w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)])
        doc, *columns = periodic_runs.slice_runs(docs)
        assert [[tuple(map(int, r[1:])) for r in zip(doc, *columns) if r[0] == i] for i in range(len(docs))] == [brute_runs(w) for w in docs]
    (long,) = periodic_runs.slice_runs([[b"x", b"y"] * 100_000])[1:2]
    assert long.tolist() == [0]
    assert periodic_runs.periodic_runs(hard.limit(0)).count() == 0
    rows = periodic_runs.periodic_runs(hard, with_text=True).where("doc_id = 7").collect()
    assert [(r["collapsed"], r["n_dropped"]) for r in rows] == [("x a b c d e f g", 39 * 7)]


def test_extensions_against_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(40):
        n = int(rng.integers(1, 120))
        s = rng.integers(0, rng.integers(1, 4), n)
        s = np.tile(s[: max(1, n // 7)], 8)[:n] if trial % 3 == 0 else s
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(s) + 1), np.arange(len(s) + 1)))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i, j):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            want.append(k)
        assert CoverLCE(s).lce(i, j).tolist() == want


def test_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(1)
    most = np.uint64(2**64 - 1)
    every = np.unique(np.append(rng.integers(0, 2**64, 3000, dtype=np.uint64), np.array([0, most], np.uint64)))
    for held in (every, every[:-1], every[1:], every[:1], every[:0], every[-1:], np.arange(5, dtype=np.uint64)):
        vocab = language_model.Vocabulary(held, np.ones(len(held), int), language_model.rare_leaf(held), np.ones(language_model.LEAVES), 1, 1, 1)
        assert len(vocab.places) >= len(held)  # no search through the whole table
        at = {h: i for i, h in enumerate(held.tolist())}
        asked = np.concatenate([every, every + np.uint64(1), np.arange(9, dtype=np.uint64)])
        assert vocab.find(asked).tolist() == [at.get(h, -1) for h in asked.tolist()]


def test_moves_of_a_step_are_summed_by_row():
    rng = np.random.default_rng(1)
    g = rng.standard_normal((3000, 16)).astype(np.float32)
    for x in (rng.integers(0, 2000, 3000), rng.zipf(1.4, 3000) % 500, np.zeros(3000, int), np.arange(3000)):
        order = np.argsort(x, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(x[order]) > 0))
        got = language_model._sums(g, order, first, np.diff(np.append(first, len(x))))
        assert np.allclose(got, [g[x == k].sum(0) for k in np.unique(x)], atol=1e-4)


@pytest.mark.parametrize("kind, learnt", [(packing, "_learnt"), (token_files, "_learn")])
def test_what_a_full_cache_still_needs_is_not_worked_out_again(kind, learnt, monkeypatch):
    cls = packing.WordTokens if kind is packing else token_files.ByteTokens
    words, new = cls(kind.tokenizer_path(), 40), []
    work = getattr(cls, learnt)
    monkeypatch.setattr(cls, learnt, lambda self, some: new.append(set(some)) or work(self, some))
    texts = [" ".join(f"{w}{i}x, kept{k}." for i in range(6)) for k, w in enumerate(("a", "b", "Été", "d", "e"))]
    whole = cls(kind.tokenizer_path(), 10**6)
    for a, b in zip(texts, texts[1:] + texts[:1]):
        both = f"{a} {b}"
        if kind is packing:
            assert words.encode([both])[0].tolist() == whole.tokenizer.encode(both, add_special_tokens=False).ids
        else:
            assert words.encode([both.encode()])[0].tolist() == whole.tokenizer.encode(both, add_special_tokens=False).ids
    known = new[::2] if len(new) > 8 else new  # the reference instance learns nothing
    assert all(not x & y for x, y in zip(known, known[1:]))  # what two texts in a row share is worked out once
