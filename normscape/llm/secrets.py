"""Operator 7: secret scans with a random forest that removes false positives.

Candidates (long mixed strings, assigned values, key blocks) are found in one Python pass over whole texts, with
features: length, character transitions, dictionary coverage, path and neighbouring words. A Spark ML random forest,
trained from labelled findings (a bounded set: LABELLED made-up snippets unless a table is given), decides them.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normscape.llm.common import batch, saved, slices, small_side

LABELLED = 3000
TREES, DEPTH = 40, 8
THRESHOLD = 0.5
MASK = "[SECRET]"

_RUN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_SPLIT = re.compile(r"=+(?=[^=])")
_SIGN = re.compile(r"[:=]")
_VALUE = re.compile(r"[:=]\s{0,3}[\"']?([^\s\"']{6,})")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
_PRIVATE = re.compile(r"(?:.* )?PRIVATE KEY(?: BLOCK)?")
_WORD = re.compile(r"[A-Za-z]+")
# fixed word lists
_SECRET_WORDS = {"password", "passwd", "pwd", "secret", "token", "apikey", "api", "key", "credential", "credentials", "auth", "bearer", "authorization", "access", "private"}
_PUBLIC_WORDS = {"sha", "md", "hash", "digest", "commit", "checksum", "etag", "revision", "id", "uuid", "guid", "version", "url", "path", "file", "build", "integrity", "public", "fingerprint"}
_DUMMY_WORDS = {"example", "sample", "test", "dummy", "placeholder", "your", "changeme", "here", "fake", "xxxx", "insert", "replace"}
_DICTIONARY = sorted(_SECRET_WORDS | _PUBLIC_WORDS | _DUMMY_WORDS | set("the and for with this that user name data value config service client server default main index page image content module function method string number list object class type error result request response session cookie header account project version release update document section chapter static assets".split()), key=len, reverse=True)
_DICTIONARY_RE = re.compile("|".join(w for w in _DICTIONARY if len(w) > 2), re.IGNORECASE)
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "xox", "glpat-", "AIza", "eyJ", "-----BEGIN")
_CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits)
_TRANSITIONS = [a + b for a in "ludo" for b in "ludo"]


class _Kinds(dict):
    """For str.translate: the class of each character, `o` for the many others."""

    def __missing__(self, code: int) -> str:
        return "o"


_KIND = _Kinds({ord(c): k for k, chars in zip("lud", _CLASSES) for c in chars})


def _blocks(text: str) -> list[tuple[int, int]]:
    """Private keys from each BEGIN line to its own END line; without one to the next BEGIN or the end of the text."""
    out, label, start = [], None, 0
    if "-----BEGIN" not in text:
        return out
    for m in _MARK.finditer(text):
        if label is not None and (m[1] == "BEGIN" or m[2] == label):
            out.append((start, m.end() if m[1] == "END" else m.start()))
            label = None
        if m[1] == "BEGIN" and _PRIVATE.fullmatch(m[2]):
            label, start = m[2], m.start()
    if label is not None:
        out.append((start, len(text)))
    return [(i, i + len(text[i:j].rstrip())) for i, j in out]


def _mixed(s: str) -> bool:
    return len(s) >= 16 and any(c in _CLASSES[2] for c in s) and any(c.isalpha() for c in s)


def _runs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The mixed parts between inner '=' signs (KEY=value), or the whole if no part is one by itself."""
    s = text[start:end]
    cuts = [(m.start(), m.end()) for m in _SPLIT.finditer(s)]
    edges = zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(s)])
    parts = [(start + i, start + j) for i, j in edges if _mixed(s[i:j])]
    return parts or ([(start, end)] if _mixed(s) else [])


def _assigned(text: str) -> list[tuple[int, int]]:
    """Values after ':' or '=' with a secret word before it; signs inside such a value belong to it."""
    out, done = [], 0
    for m in _SIGN.finditer(text):
        if m.start() < done:
            continue
        before = {w.lower() for w in _WORD.findall(text[max(0, m.start() - 24) : m.start()])[-2:]}
        value = _VALUE.match(text, m.start()) if before & _SECRET_WORDS else None
        if value:
            out.append(value.span(1))
            done = value.end()
    return out


def _free(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted, disjoint spans in taken leave of a span."""
    out = []
    for i in range(bisect.bisect_right(taken, start, key=lambda t: t[1]), len(taken)):
        if taken[i][0] >= end:
            break
        out.append((start, taken[i][0]))
        start = taken[i][1]
    return [(i, j) for i, j in [*out, (start, end)] if i < j]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what may be a secret: key blocks, then assigned values, then runs.

    What a span of an earlier kind leaves of a later one is looked at again by itself. A value that is also a run
    counts as one.
    """
    taken = _blocks(text)
    out = [(*f, "block") for f in taken]
    runs = [m.span() for m in _RUN.finditer(text)]
    whole = {r for m in runs for r in _runs(text, *m)}
    values = [f for v in _assigned(text) for f in _free(*v, taken) if f[1] - f[0] >= 6]
    out += [(*f, "run" if f in whole else "assigned") for f in values]
    taken = sorted(taken + values)
    out += [(*r, "run") for m in runs for f in _free(*m, taken) for r in _runs(text, *f)]
    return sorted(out)


def features(text: str, start: int, end: int, path: str) -> list[float]:
    """The forest's features, of the whole candidate."""
    s = text[start:end]
    kinds = s.translate(_KIND)
    moves = Counter(map("".join, zip(kinds, kinds[1:])))
    n = max(1, len(s))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    covered = sum(len(m.group()) for m in _DICTIONARY_RE.finditer(s)) / n
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-4:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 32])][:2]
    near, lead = set(before[-3:]), text[max(0, start - 4) : start]
    where = {w.lower() for w in _WORD.findall(path)}
    return [
        math.log2(1 + end - start), entropy, covered, *(kinds.count(k) / n for k in "lud"),
        sum(c in string.hexdigits for c in s) / n, *(moves[t] / n for t in _TRANSITIONS),
        float(bool(near & _SECRET_WORDS)), float(bool(near & _PUBLIC_WORDS)), float(bool((near | set(after)) & _DUMMY_WORDS)),
        float("=" in lead or ":" in lead), float('"' in lead or "'" in lead), float(s.startswith(_PREFIXES)),
        float(bool(where & {"test", "tests", "example", "examples", "docs", "fixtures"})), float(bool(where & {"env", "config", "settings", "credentials"})),
    ]


def labelled_findings(n: int = LABELLED, seed: int = 7) -> list[tuple[list[float], float]]:
    """Features and label of made-up findings: keys in the usual forms against digests, ids, names and placeholders."""
    rng = random.Random(seed)
    some = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, b64 = "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    alnum, words = string.ascii_letters + string.digits, ["the", "la", "of", "und", "de", "value", "see", "in", "run"]
    cased = lambda s: rng.choice([s, s, s.upper(), s.capitalize()])
    out = []
    for i in range(n):
        label, lead, tail = float(i % 2), " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=3))
        if label:
            value = rng.choice([lambda: some(hexa, rng.choice([32, 40, 48, 64])), lambda: some(hexa, 40).upper(), lambda: some(alnum, rng.randint(20, 48)), lambda: some(b64, rng.randint(24, 64)) + "=", lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + some(alnum, 36), lambda: "sk_live_" + some(alnum, 24), lambda: some(alnum + "!#%&", rng.randint(9, 16)), lambda: "eyJ" + some(alnum, 40) + "." + some(alnum, 60)])()
            key = rng.choice(["token", "api_key", "secret", "password", "access_key", "auth token", "client_secret"])
            path = rng.choice(["src", "config/settings.py", ".env", "src0", "web/app.js", ""])
            text = lead + " " + cased(key) + rng.choice([' = "', ": ", "=", " : '"])
            if value.startswith(_PREFIXES) and rng.random() < 0.3:
                text = lead + " "
        else:
            form = rng.randrange(6)
            value = [some(hexa, rng.choice([32, 40, 64])), some(hexa, 8) + "-" + some(hexa, 4) + "-4" + some(hexa, 3) + "-" + some(hexa, 12), "your_api_key_here_" + some("123", 2), rng.choice(["example", "test", "dummy"]) + some(string.digits, 10), "/".join(["assets", rng.choice(["image", "page", "module"]), "index_" + some(string.digits, 6)]), rng.choice(["get", "set"]) + "UserAccount" + rng.choice(["Service", "Config", "Request"]) + "V" + some("123", 1)][form]
            key = rng.choice([["sha256", "md5", "commit", "checksum", "digest"], ["id", "uuid", "guid"], ["api_key", "token", "password"], ["secret", "token", "key"], ["url", "path", "file"], ["function", "method", "class"]][form])
            path = rng.choice(["tests/test_app.py", "docs/example.md", "src", "src1", "CHANGELOG", ""])
            text = lead + " " + cased(key) + rng.choice([' = "', ": ", "=", " ", " : '"])
        text, start = text + value, len(text)
        out.append((features(text + '" ' + tail, start, len(text), path), label))
    return out


def train(spark: SparkSession, labelled: list[tuple[list[float], float]] | DataFrame | None = None):
    """The forest, from rows (features array<double>, label double)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labelled if isinstance(labelled, DataFrame) else spark.createDataFrame(labelled or labelled_findings(), "features array<double>, label double").coalesce(1)
    rows = rows.select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=16, subsamplingRate=0.7, seed=11).fit(rows)


def scan(docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, length, kind, secret_sha256, probability, is_secret, text_hash): every candidate and the forest's verdict.

    start and length count characters; text_hash is the xxhash64 of the text, which tells rows of one id apart. Null and empty texts have no candidate; a null path counts as empty.
    Repeated rows repeat their findings; other columns are left out, so names cannot clash.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = model or train(docs.sparkSession)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("binary").alias("body"))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string()), ("secret_sha256", pa.string()), ("features", pa.list_(pa.float64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, paths, hashes, bodies in slices(batches):
            out = []
            for i, p, h, b in zip(ids, paths, hashes, bodies):
                text = b.decode("utf-8", "replace")
                for start, end, kind in candidates(text):
                    digest = hashlib.sha256(text[start:end].encode()).hexdigest()
                    out.append((i, h, start, end - start, kind, digest, features(text, start, end, p)))
            if out:
                yield batch(schema, *zip(*out))

    found = rows.mapInArrow(find, "doc_id long, text_hash long, start int, length int, kind string, secret_sha256 string, features array<double>")
    found = model.transform(found.withColumn("features", array_to_vector("features")))
    p = vector_to_array("probability")[1]
    return found.select("doc_id", "start", "length", "kind", "secret_sha256", p.alias("probability"), (p >= threshold).alias("is_secret"), "text_hash")


def _masked(text: str, starts, lengths) -> str:
    """The pieces between the spans, joined once."""
    pieces, at = [], 0
    for start, length in zip(starts, lengths):
        if start >= at:
            pieces += [text[at:start], MASK]
        at = max(at, start + length)
    return "".join([*pieces, text[at:]])


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each confirmed secret replaced by MASK; all rows and columns stay.

    Findings belong to the rows with their id (null to null) and their very text.
    """
    spans = findings.where("is_secret").select("doc_id", "text_hash", "start", "length").distinct()
    spans = spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__spans"))
    side, text = small_side(saved(spans, "spans")), docs[text_col]
    own = lambda t: docs[id_col].cast("long").eqNullSafe(t["__id"]) & (F.xxhash64(text) == t["__hash"])

    @F.pandas_udf("string")
    def masked(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([_masked(*x) for x in zip(texts, starts, lengths)], dtype=object)

    # texts with a secret alone go through Python; the pass over all rows only takes in what came out
    cut = masked(text, F.transform("__spans", lambda x: x["start"]), F.transform("__spans", lambda x: x["length"]))
    hit = docs.join(side, own(side)).select(side["__id"], side["__hash"], cut.alias("__clean")).dropDuplicates(["__id", "__hash"])
    hit = small_side(saved(hit, "masked"))
    joined = docs.join(hit, own(hit), "left")
    clean = F.coalesce(hit["__clean"], text).alias(text_col)
    return joined.select(*[clean if c == text_col else docs[c] for c in docs.columns])


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLES: dict[str, str] = {}
