"""Operator 2: licence scans by a trained paragraph classifier.

A sparse logistic regression over hashed word 1- and 2-grams gives each line of a document the probability of each
licence family and of no licence; a temperature fitted on held-out paragraphs calibrates it. A line is `unknown` if
it reads like a licence but no family is likely enough or no template of that family resembles it. Training data:
perturbed templates against paragraphs of a bounded sample of documents (SAMPLE_DOCS in expectation).

The same classifier reads overlapping word windows of each paragraph (neighbouring lines joined), so that a notice in a
long line or wrapped over lines is found; a window counts only if a family is likely and its template confirms it.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normscape.llm.common import WordCache, batch, hash_words, mix, slices, text_rows

BUCKETS = 1 << 15
SAMPLE_DOCS = 400
MAX_PARAGRAPHS = 6000
LIKELY, SIMILAR = 0.5, 0.6
WINDOWS = (5, 8, 12, 20, 32)  # words; each moves on by a quarter of itself
_STRIP = b".,;:!?\"'()[]{}*#%&$|<>"

#: Fixed phrases of public licences, by family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
FAMILIES = list(TEMPLATES)
NONE = len(FAMILIES)


def normal(word: bytes) -> bytes:
    return word.lower().strip(_STRIP)


def _word_hashes(words: list[bytes]) -> tuple[np.ndarray]:
    return hash_words([normal(w) for w in words])


def line_features(texts: list[bytes], words: WordCache) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]], np.ndarray]:
    """Buckets of 1- and 2-grams (BUCKETS: none) at each word, lines' first words, lines a text, the lines' words, and the 2-grams across lines."""
    lines, per_text = [], []
    for t in texts:
        own = [w for w in (x.split() for x in t.split(b"\n"))]
        lines += own
        per_text.append(len(own))
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    (h,) = words.look([w for x in lines for w in x])
    one = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    two = np.full(len(h), BUCKETS)
    if len(h) > 1:
        two[:-1] = (mix(h[:-1] * np.uint64(3) + h[1:]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    across = two.copy()
    two[np.cumsum(lengths)[lengths > 0] - 1] = BUCKETS
    return np.stack([one, two]), np.cumsum(lengths) - lengths, np.array(per_text), lines, across


def window_spans(starts: np.ndarray, lengths: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of the windows of all paragraphs (lines up to an empty one or the end of the text)."""
    new = np.append(True, lengths[:-1] == 0) if len(lengths) else np.zeros(0, bool)
    new[(np.cumsum(per_text) - per_text)[per_text > 0]] = True
    first = starts[new]
    ends = np.append(first[1:], lengths.sum())
    firsts, lasts = [], []
    for size in WINDOWS:
        step = max(1, size // 4)
        n = np.where(ends > first, -(-np.maximum(ends - first - size, 0) // step) + 1, 0)
        at = np.repeat(first, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        firsts.append(at)
        lasts.append(np.minimum(at + size, np.repeat(ends, n)))
    return np.concatenate(firsts), np.concatenate(lasts)


def window_logits(weights: np.ndarray, one: np.ndarray, across: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """line_logits() of windows, from running sums of one class after another."""
    out, root = np.empty((len(first), weights.shape[1])), np.sqrt(end - first)
    for k in range(weights.shape[1]):
        own = np.ascontiguousarray(weights[:, k], np.float64)
        a, b = (np.append(0.0, np.cumsum(own[g])) for g in (one, across))
        out[:, k] = own[-1] + (a[end] - a[first] + b[end - 1] - b[first]) / root
    return out


def line_logits(weights: np.ndarray, grams: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean weight of each line's n-grams, times a slow growth with their number, plus the bias (the last row)."""
    out = np.tile(weights[-1], (len(starts), 1))
    some = lengths > 0
    if some.any():
        total = sum(np.add.reduceat(weights[g], starts[some]) for g in grams)
        out[some] += total / np.sqrt(lengths[some])[:, None]
    return out


def probabilities(logits: np.ndarray, temperature: float) -> np.ndarray:
    z = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
    return z / z.sum(1, keepdims=True)


def training_paragraphs(negatives: list[bytes], seed: int = 3) -> list[tuple[bytes, int]]:
    """Templates with words dropped, cut and framed, and the negatives (those that resemble a template left out)."""
    rng, out = random.Random(seed), []
    fill = [w for n in negatives[:200] for w in n.split()] or [b"text", b"of", b"no", b"licence"]
    for family, texts in enumerate(TEMPLATES.values()):
        for t in texts:
            ws = t.encode().split()
            for i in range(40):
                x = [w for w in ws if i < 8 or rng.random() > 0.08] or ws
                if i % 4 == 1:
                    x = rng.choices(fill, k=rng.randint(1, 4)) + x
                if i % 4 == 2:
                    x = x + rng.choices(fill, k=rng.randint(1, 4))
                out.append((b" ".join(x), family))
    for n in negatives[:MAX_PARAGRAPHS]:
        if n.split() and resemblance(n.split())[1] < SIMILAR / 2 and not holds_template(n.split()):
            out.append((n, NONE))
    loose = "the license of driving, version of the work, permission to go, free of charge entry, public works, the general form, source of water, released in may, work is done, under the bridge".split(", ")
    out += [(x.encode(), NONE) for x in loose * 10]
    rng.shuffle(out)
    return out


def resemblance(words: list[bytes], family: int | None = None) -> tuple[int, float]:
    """(family, share): the template (of that family) whose words are best covered by the line's, less what is extra."""
    mine = {w for w in map(normal, words) if w}
    best = (NONE, 0.0)
    for f, sets in enumerate(_TEMPLATE_SETS):
        for s in sets if family in (None, f) else ():
            share = len(mine & s) / len(s) * min(1.0, 2 * len(s) / max(1, len(mine)))
            best = max(best, (f, share), key=lambda x: x[1])
    return best


def holds_template(words: list[bytes]) -> bool:
    """Whether a window of the words resembles a template."""
    mine = {normal(w) for w in words}
    if not any(len(mine & s) >= SIMILAR * len(s) for sets in _TEMPLATE_SETS for s in sets):
        return False
    return any(resemblance(words[i : i + n])[1] >= SIMILAR for n in WINDOWS for i in range(0, max(1, len(words) - n + n // 4), max(1, n // 4)))


_TEMPLATE_SETS = [[{w for w in map(normal, t.encode().split()) if w} for t in ts] for ts in TEMPLATES.values()]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epochs: int = 120) -> tuple[np.ndarray, float]:
    """(weights, temperature), learnt on the driver from templates and the bounded sample."""
    total = docs.count()
    scale = 1 << 30
    some = text_rows(docs, id_col, text_col).where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, SAMPLE_DOCS / max(total, 1))))
    lines = some.select(F.explode(F.split(F.col("body").cast("string"), "\n")).alias("line")).where("trim(line) <> ''")
    negatives = [r[0].encode() for r in lines.orderBy(F.xxhash64("line"), "line").limit(MAX_PARAGRAPHS).collect()]
    rows = training_paragraphs(negatives)
    texts, labels = [t.replace(b"\n", b" ") for t, _ in rows], np.array([y for _, y in rows])
    grams, starts, _, found, _ = line_features(texts, WordCache(_word_hashes))
    lengths = np.array([len(x) for x in found])
    held = np.arange(len(rows)) % 4 == 0
    weights = np.zeros((BUCKETS + 2, NONE + 1))
    target = np.eye(NONE + 1)[labels]
    share = np.where(held, 0.0, 1 / np.bincount(labels, minlength=NONE + 1)[labels])[:, None] * 100
    at = np.repeat(np.arange(len(rows)), lengths)
    for epoch in range(epochs):
        g = (probabilities(line_logits(weights, grams, starts, lengths), 1.0) - target) * share
        scaled = (g / np.sqrt(np.maximum(lengths, 1))[:, None])[at]
        step = np.zeros_like(weights)
        for x in grams:
            for c in range(NONE + 1):
                step[:-1, c] += np.bincount(x, scaled[:, c], BUCKETS + 1)
        step[-1] = g.sum(0)
        step[BUCKETS] = 0
        weights -= 0.05 * step + 1e-4 * weights
    logits = line_logits(weights, grams, starts, lengths)[held]
    loss = lambda t: -np.log(probabilities(logits, t)[np.arange(held.sum()), labels[held]] + 1e-12).mean()
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    return weights.astype(np.float32), temperature


def scan(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity): a row for each line or window that reads like a licence.

    paragraph counts lines from 0; a window stands at its first line with two words of the template, and gives a row
    for each such line and family where no confirmed line or better window holds its words. family is `unknown` if no family is likely enough or its templates do not confirm
    it. Null and empty texts have no line. Repeated rows repeat their findings; other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache(_word_hashes)
        weights, temperature = sent.value
        for ids, texts in slices(batches):
            grams, starts, per_text, lines, across = line_features(texts, words)
            lengths = np.fromiter(map(len, lines), np.int64, len(lines))
            p = probabilities(line_logits(weights, grams, starts, lengths), temperature)
            firsts = np.cumsum(per_text) - per_text
            rows, unsure, taken = {}, [], np.zeros(len(across), bool)
            for at in np.flatnonzero((p[:, NONE] < LIKELY) & (lengths > 0)):
                f = int(p[at, :NONE].argmax())
                _, share = resemblance(lines[at], f)
                if p[at, f] >= LIKELY and share >= SIMILAR:
                    rows[at, f] = (float(p[at, f]), share)
                    taken[starts[at] : starts[at] + lengths[at]] = True
                else:
                    unsure.append((at, float(1 - p[at, NONE]), share))
            first, end = window_spans(starts, lengths, per_text)
            q = probabilities(window_logits(weights, grams[0], across, first, end), temperature) if len(first) else np.zeros((0, NONE + 1))
            flat, hits = [w for x in lines for w in x], []
            for w in np.flatnonzero(q[:, :NONE].max(1, initial=0) >= LIKELY):
                i, j, f = int(first[w]), int(end[w]), int(q[w, :NONE].argmax())
                if not taken[i:j].all() and (share := resemblance(flat[i:j], f)[1]) >= SIMILAR:
                    hits.append((-share, j - i, i, j, f, float(q[w, f])))
            for share, _, i, j, f, likely in sorted(hits):
                if not taken[i:j].any():
                    taken[i:j] = True
                    known = set().union(*_TEMPLATE_SETS[f])
                    of = np.searchsorted(starts, np.arange(i, j), side="right") - 1
                    mine = Counter(o for o, x in zip(of.tolist(), flat[i:j]) if normal(x) in known)
                    rows.setdefault((min((o for o, n in mine.items() if n > 1), default=int(of[0])), f), (likely, -share))
            found = [(at, FAMILIES[f], *x) for (at, f), x in rows.items()]
            found += [(at, "unknown", *x) for at, *x in unsure if not taken[starts[at] : starts[at] + lengths[at]].any()]
            out = []
            for at, *x in sorted(found):
                doc = np.searchsorted(firsts, at, side="right") - 1
                out.append((ids[doc], int(at - firsts[doc]), *x))
            if out:
                yield batch(schema, *zip(*out))

    return text_rows(docs, id_col, text_col).mapInArrow(find, "doc_id long, paragraph int, family string, probability double, similarity double")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
