"""Language identification with hyperdimensional profiles.

Every letter of Unicode has its own random +1/-1 vector, drawn from its code point.  A letter trigram is the product (binding) of its letters' vectors, each
permuted by its place; a text is the sum (bundle) of its trigrams, and a language's prototype is the sum of its
training texts' bundles.  A text gets the language whose prototype has the largest cosine with the text's bundle.

Bundling is linear, so a task keeps trigram counts per language, adds sparse ones to the language's bundle whenever
there are many, and gives one bundle per language: training reads the whole table in one pass and shuffles a row per
task and language.  No sample, prefix or cap is used.

Defined results: null text, empty text and text without a letter give ``und`` and score 0; ties go to the
language that sorts first; without any training text every document is ``und``; a cosine below 0 scores 0.
Repeated rows are scored alike; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvello.llm.common import kinds, with_text

#: Numbers of characters: 0 for all but letters, 1-26 for a-z, 27-58 for the small letters of Latin-1, and for every
#: other letter its code point.  A trigram of numbers below ALPHABET is coded in 18 bits, any other one in 63 bits and
#: below zero.
ALPHABET = 64
DIMENSIONS = 1024
SEED = 20_261
_WIDE, _MASK, _SIGN = 21, (1 << 21) - 1, np.int64(-(1 << 63))
#: Other trigrams that a task counts for a language before it adds them to the bundle, and vectors made at once.
_HELD, _BLOCK = 65_536, 1024
#: Languages for which a task holds counts at a time, a megabyte each; bundles (8 kB each) are held for all.
_LANGUAGES = 32


@lru_cache(1)
def letter_numbers() -> np.ndarray:
    numbers = np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int64)
    own = [*range(ord("a"), ord("z") + 1), *(c for c in range(0xDF, 0x100) if c != 0xF7)]
    numbers[own] = np.arange(1, 1 + len(own))
    return numbers


@lru_cache(1)
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of numbers below ALPHABET, permuted (rotated) for the first, second and third place of a trigram."""
    vectors = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (ALPHABET, DIMENSIONS))
    return np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1), vectors


@lru_cache(16_384)
def letter_vector(number: int) -> np.ndarray:
    if number < ALPHABET:
        return letter_vectors()[2][number].astype(np.int8)
    return np.random.default_rng((SEED, number)).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    first, second, third = letter_vectors()
    wide = np.flatnonzero(grams < 0)
    if not len(wide):
        return first[grams >> 12] * second[(grams >> 6) & 63] * third[grams & 63]
    out = np.empty((len(grams), DIMENSIONS), np.float32)
    own = np.flatnonzero(grams >= 0)
    out[own] = trigram_vectors(grams[own])
    codes = grams[wide]
    letters, at = np.unique(np.stack([codes >> 2 * _WIDE & _MASK, codes >> _WIDE & _MASK, codes & _MASK]), return_inverse=True)
    vectors, at = np.array([letter_vector(n) for n in letters.tolist()], np.float32), at.reshape(3, len(wide))
    out[wide] = np.roll(vectors, 2, axis=1)[at[0]] * np.roll(vectors, 1, axis=1)[at[1]] * vectors[at[2]]
    return out


class _Vectors:
    """Trigram vectors made so far, as rows of one matrix, at most ``most`` of them."""

    def __init__(self, most: int = 12_288) -> None:
        self.row, self.wide = np.full(ALPHABET**3, -1, np.int32), {}
        self.rows, self.n, self.most = np.empty((0, DIMENSIONS), np.float32), 0, most

    def places(self, grams: np.ndarray) -> np.ndarray:
        own = grams >= 0
        if own.all():
            return self.row[grams]
        at = np.array([self.wide.get(g, -1) for g in grams.tolist()], np.int32)
        at[own] = self.row[grams[own]]
        return at

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        new = grams[self.places(grams) < 0]
        if len(new):
            if self.n + len(new) > self.most:
                return trigram_vectors(grams)
            if self.n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.n], np.empty((min(self.most, self.n + len(new) + _BLOCK) - self.n, DIMENSIONS), np.float32)])
            self.rows[self.n : self.n + len(new)] = trigram_vectors(new)
            own, places = new >= 0, np.arange(self.n, self.n + len(new))
            self.row[new[own]] = places[own]
            self.wide.update(zip(new[~own].tolist(), places[~own].tolist(), strict=True))
            self.n += len(new)
        return self.rows[self.places(grams)]


def bundled(grams: np.ndarray, weights: np.ndarray, vectors=trigram_vectors) -> np.ndarray:
    """Sum of the weights times the trigrams' vectors."""
    blocks = (slice(i, i + _BLOCK) for i in range(0, len(grams), _BLOCK))
    return sum((weights[b].astype(np.float32) @ vectors(grams[b]) for b in blocks), np.zeros(DIMENSIONS))


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams of letters of a text between two blanks; runs of other characters are one blank."""
    codes = letter_numbers()[np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = codes > 0
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes = codes[keep]
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    own = (first << 12) | (second << 6) | third
    if codes.max() < ALPHABET:
        return own
    return np.where((first | second | third) < ALPHABET, own, (first << 2 * _WIDE) | (second << _WIDE) | third | _SIGN)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    others: dict[str, dict[int, float]] = {}
    sums: dict[str, np.ndarray] = {}

    def fold(lang: str) -> None:
        held = others.pop(lang)
        sums[lang] = sums.get(lang, 0) + bundled(np.fromiter(held, np.int64, len(held)), np.fromiter(held.values(), np.float64, len(held)))

    def fold_all() -> None:
        for lang in list(counts):
            total = counts.pop(lang)
            at = np.flatnonzero(total)
            sums[lang] = sums.get(lang, 0) + bundled(at, total[at])
        for lang in list(others):
            fold(lang)

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            grams = trigrams(text.as_py())
            if len(grams):
                # Each document weighs as much as the next; else a few long ones would be the profile.
                found, n = np.unique(grams, return_counts=True)
                weights, wide = n / np.sqrt(len(grams)), int(np.searchsorted(found, 0))
                if lang not in counts:
                    if len(counts) == _LANGUAGES:
                        fold_all()
                    counts[lang] = np.zeros(ALPHABET**3, np.float32)
                counts[lang][found[wide:]] += weights[wide:]
                held = others.setdefault(lang, {})
                for g, w in zip(found[:wide].tolist(), weights[:wide].tolist(), strict=True):
                    held[g] = held.get(g, 0.0) + w
                if len(held) > _HELD:
                    fold(lang)
    fold_all()
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total, pa.float64())], ["lang", "at", "weight"])


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from all rows of (text, lang) that have both.

    What reaches the driver is one bundle for each language, whatever the input's size.
    """
    sums = (
        with_text(labelled.where("text IS NOT NULL AND lang IS NOT NULL"), ["text", "lang"])[0]
        .mapInArrow(_bundles, "lang string, at int, weight double")
        .groupBy("lang", "at").agg(F.sum("weight").alias("weight"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("bundle"))
    )
    found = sorted((r.lang, [p.weight for p in r.bundle]) for r in sums.collect())
    rows = [np.array(total) / max(float(np.linalg.norm(total)), 1e-12) for _, total in found]
    return [lang for lang, _ in found], np.array(rows).reshape(len(found), DIMENSIONS)


def cosines(text: str | None, profiles: np.ndarray, vectors=trigram_vectors) -> np.ndarray | None:
    grams = trigrams(text) if text else ()
    if not len(grams) or not len(profiles):
        return None
    found, n = np.unique(grams, return_counts=True)
    total = bundled(found, n, vectors)
    return profiles @ (total / max(float(np.linalg.norm(total)), 1e-12))


def identify(docs: DataFrame, langs: list[str], profiles: np.ndarray, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, unless given) with lang_pred and score, which come from column ``text`` alone.

    Columns of those two names that ``docs`` may have are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    profiles = profiles.astype(np.float32)
    names, n = [*keep, "lang_pred", "score"], len(keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors()
        for batch in batches:
            lang, score = [], []
            for text in batch.column(at):
                found = cosines(text.as_py(), profiles, vectors)
                best = None if found is None else int(found.argmax())
                lang.append("und" if best is None else langs[best])
                score.append(0.0 if best is None else min(1.0, max(0.0, float(found[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names)

    read, at = with_text(docs, keep, text)
    return read.mapInArrow(scored, ", ".join([*kinds(read, keep), "lang_pred string, score double"]))
