"""License scans: a trained paragraph classifier over word n-grams, confirmed by templates.

Paragraphs are lines that are confirmed on their own and, of each block between blank lines (also lines of comment
markers alone), all its other lines joined, so notices may be wrapped.  Their words are cut down to the classifier's vocabulary (words of the licence templates that are
rare in ordinary paragraphs), and the 1-, 2- and 3-grams of what is left, at most a few thousand features, have sparse
weights for each licence family and for the unknown class.  Only paragraphs with a word of the vocabulary meet the
weights, in a broadcast join of bounded size; all others are unknown.  Probabilities are a softmax whose temperature is
fitted on whole templates, with their damaged copies, and on paragraphs that the weights of a first fit have not seen.  A prediction is confirmed if the paragraph has most of the words of
one of the family's templates.

Scoring is DataFrame expressions throughout.  Fitting takes the templates, their damaged copies and the paragraphs of
BACKGROUND documents (those with the least hashes of doc_id), on the driver.  No document is labelled: what has most of a
template's words is left out of the background, all else of it counts as unknown.

Defined results: null and empty texts and texts without a known word have no family and probability 0; of several
paragraphs a confirmed one counts before others, then the one with the highest probability, then the first; repeated rows are scanned each, also of null
doc_id; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvello.llm.common import discard, materialise

UNKNOWN = "unknown"
BACKGROUND, BACKGROUND_CHARS = 300, 20_000
#: Words of more than this share of ordinary paragraphs are no vocabulary.
ORDINARY = 0.01
CONFIRMED = 0.6
#: Of so many templates of a family or paragraphs one is held out of the first fit.
HELD = 3
PROBABILITY = 0.5
#: Line ends around lines without a letter or digit.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"

# Fixed texts: short notices by which the licence families are named in files.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}

_SEPARATOR = "[^a-z0-9]+"


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(_SEPARATOR, text.translate(_LOWER)) if w]


_LOWER = {c: c + 32 for c in range(65, 91)}


def ngrams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@dataclass
class Model:
    vocabulary: list[str]
    classes: list[str]  # the last one is the unknown class
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float


def damaged(text: str, rng: random.Random) -> str:
    """A copy with some words lost, doubled or changed."""
    words = text.split()
    out = [w for w in words for _ in range(rng.choice((0, 1, 1, 1, 1, 1, 1, 1, 1, 2)))]
    return " ".join([*rng.choices(("###", "&", "//", "x"), k=rng.randrange(3)), *(out or words)])


def fit(background: list[str], seed: int = 8) -> Model:
    """Multinomial logistic regression; the temperature is that of a first fit without every HELD-th template and paragraph."""
    rng = random.Random(seed)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    templates = [set(plain_words(t)) for ts in TEMPLATES.values() for t in ts]
    ordinary = [w for w in (plain_words(p) for p in background) if w and not any(len(t & set(w)) >= CONFIRMED * len(t) for t in templates)]
    seen = Counter(w for words in ordinary for w in set(words))
    vocabulary = sorted({w for t in templates for w in t if seen[w] <= ORDINARY * max(100, len(ordinary))})
    known = set(vocabulary)
    # A template's copies stay on one side; each family keeps its first template for the first fit.
    examples = [(plain_words(text), classes.index(family), k % HELD == HELD - 1) for family, texts in sorted(TEMPLATES.items()) for k, t in enumerate(texts) for text in (t, *(damaged(t, rng) for _ in range(12)))]
    examples += [(w, len(classes) - 1, k % HELD == 0) for k, w in enumerate([*ordinary, *([w] for w in vocabulary)])]
    # Ordinary paragraphs that happen to have some of the vocabulary.
    examples += [(rng.sample(vocabulary, min(len(vocabulary), rng.randrange(1, 4))), len(classes) - 1, k % HELD == 0) for k in range(300)]
    rng.shuffle(examples)
    rows = [(Counter(ngrams([w for w in words if w in known])), y, held) for words, y, held in examples]
    rows = [r for r in rows if r[0]]
    learn, hold = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    names = sorted({f for found, _, _ in rows for f in found})
    number = {f: k for k, f in enumerate(names)}

    def matrix(part: list) -> np.ndarray:
        x = np.zeros((len(part), len(names) + 1), np.float32)
        x[:, -1] = 1
        for k, (found, _, _) in enumerate(part):
            x[k, [number[f] for f in found]] = 1
        return x

    def weights(part: list) -> np.ndarray:
        x, y = matrix(part), np.eye(len(classes), dtype=np.float32)[[y for _, y, _ in part]]
        theta = np.zeros((x.shape[1], len(classes)), np.float32)
        speed = np.full_like(theta, 1e-6)
        for _ in range(200):
            z = x @ theta
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            grad = x.T @ (p - y) / len(x) + 1e-4 * theta
            speed += grad**2
            theta -= 0.5 * grad / np.sqrt(speed)
        return theta

    z, target = matrix(hold) @ weights(learn), np.array([y for _, y, _ in hold])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), target]).mean())

    temperature = min((0.5 * 1.1**k for k in range(30)), key=loss) if len(hold) else 1.0
    theta = weights(rows)
    kept = np.abs(theta[:-1]).max(axis=1) > 0.05
    return Model(vocabulary, classes, {f: theta[k].tolist() for f, k in number.items() if kept[k]}, theta[-1].tolist(), temperature)


def train(docs: DataFrame) -> Model:
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(BACKGROUND).distinct()
    some = docs.where(F.length("text") <= BACKGROUND_CHARS).join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text")
    rows = sorted(some.limit(2 * BACKGROUND).collect(), key=lambda r: (r.doc_id, r.text))
    return fit([p for r in rows for p in r.text.split("\n")])


def _words(text: Column) -> Column:
    return F.split(F.translate(text, "".join(map(chr, _LOWER)), "".join(map(chr, _LOWER.values()))), _SEPARATOR, -1)


def _judged(lines: DataFrame, model: Model) -> DataFrame:
    """row, line, family, probability, share and confirmed of the licensed ones of lines (row, line, words)."""
    spark = lines.sparkSession
    words = F.col("words")
    n = F.size(words)
    grams = lambda k: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    features = F.concat(words, *(F.when(n >= k, grams(k)).otherwise(F.slice(words, 1, 0)) for k in (2, 3)))
    weights = spark.createDataFrame(sorted(model.weights.items()) or [("", [0.0] * len(model.classes))], "feature string, w array<double>")
    each = lines.select("row", "line", F.explode(F.array_distinct(features)).alias("feature")).join(F.broadcast(weights), "feature")
    logits = [(F.coalesce(F.sum(F.get("w", F.lit(k))), F.lit(0.0)) + b) / model.temperature for k, b in enumerate(model.bias)]
    scored = each.groupBy("row", "line").agg(*(z.alias(f"z{k}") for k, z in enumerate(logits)))
    total = sum((F.exp(F.col(f"z{k}") - F.col("top")) for k in range(len(logits))), F.lit(0.0))
    best = F.greatest(*(F.col(f"z{k}") for k in range(len(logits) - 1)))
    family = F.coalesce(*(F.when(F.col(f"z{k}") == best, c) for k, c in enumerate(model.classes[:-1])))
    top = F.greatest(best, F.col(f"z{len(logits) - 1}"))
    scored = scored.select("row", "line", family.alias("family"), best.alias("best"), top.alias("top"), *(f"z{k}" for k in range(len(logits))))
    scored = scored.select("row", "line", "family", (F.exp(F.col("best") - F.col("top")) / total).alias("probability")).where(F.col("probability") >= PROBABILITY)
    # Template comparison: the share of a template's vocabulary that the line has, the best template of the family.
    known = set(model.vocabulary)
    templates = [(family, words) for family, texts in sorted(TEMPLATES.items()) for t in texts if (words := sorted(set(plain_words(t)) & known))]
    templates = spark.createDataFrame(templates or [("", [""])], "family string, template array<string>")
    share = F.size(F.array_intersect("words", "template")) / F.size("template")
    judged = scored.join(lines, ["row", "line"]).join(F.broadcast(templates), "family").groupBy("row", "line", "family", "probability").agg(F.max(share).alias("share"))
    return judged.withColumn("confirmed", F.col("share") >= CONFIRMED)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, family (null: none), probability, confirmed and n_paragraphs (licensed ones) of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split(F.coalesce("text", F.lit("")), BLANK, -1).alias("blocks"))
    # Lines keep the words of the vocabulary only; a document is one row, most with no line left.
    known_words = lambda p, block: F.struct(block.alias("block"), F.filter(_words(p), lambda w: w.isin(*model.vocabulary)).alias("words"))
    kept = F.flatten(F.transform("blocks", lambda b, j: F.filter(F.transform(F.split(b, "\n", -1), lambda p: known_words(p, j)), lambda p: F.size(p["words"]) > 0)))
    kept = kept if model.vocabulary else F.expr("cast(array() as array<struct<block:int,words:array<string>>>)")
    found = materialise(rows.select("row", "doc_id", kept.alias("lines")), "licence-words")
    lines = found.select("row", F.posexplode("lines").alias("line", "p")).select("row", "line", "p.block", "p.words")
    single = materialise(_judged(lines, model).where("confirmed"), "licence-lines")
    # What is no notice of its own is joined with its block's other lines.
    rest = lines.join(single, ["row", "line"], "left_anti").groupBy("row", "block").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "words"))).alias("all"))
    rest = rest.select("row", "line", F.flatten(F.col("all.words")).alias("words"))
    judged = single.unionByName(_judged(rest, model))
    order = F.struct("confirmed", "probability", -F.col("line"))
    by_row = judged.groupBy("row").agg(F.max_by(F.struct("family", "probability", "confirmed"), order).alias("b"), F.count(F.lit(1)).alias("n"))
    out = found.select("row", "doc_id").join(by_row, "row", "left")
    out = out.select("doc_id", F.col("b.family").alias("family"), F.coalesce("b.probability", F.lit(0.0)).alias("probability"), F.coalesce("b.confirmed", F.lit(False)).alias("confirmed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"))
    out = materialise(out, "licences")
    discard(found, single)
    return out
