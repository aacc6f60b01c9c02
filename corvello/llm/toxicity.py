"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels exist for documents only.  Tokens get theirs by distant supervision: words and word beginnings that are far more
frequent in toxic than in clean documents (a likelihood-ratio test) mark a token of a toxic document as toxic, all
other tokens are clean.  A chain with two states learns from windows of such tokens; a token's features are its word,
beginnings, endings and length, hashed.  A document's forward-backward marginals give its offending offsets (marginal
above one half), and their largest one and their sum give its score through a logistic curve that is fitted on
documents which the chain has not seen.

Fitting uses a bounded sample: TOXIC and CLEAN labelled documents of at most TRAIN_CHARS characters, those with the
least hashes of doc_id; of these, the chain learns from WINDOWS windows each at most.  Scoring reads every whole text and shuffles nothing; the model is a vector of FEATURES numbers.

Defined results: null, empty and wordless texts have no spans and get the score of a document without toxic tokens;
without labels of both kinds every score is 0; labels that are null or whose document is missing are not used, equal
labels and equal rows count once; repeated rows are scored alike; columns named as the results are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvello.llm.common import kinds, with_text

TOXIC, CLEAN, TRAIN_CHARS = 3000, 6000, 20_000
#: Windows of a clean document that look toxic, and windows of any document, that the chain learns from.
CLEAN_WINDOWS, WINDOWS = 3, 50
FEATURES = 1 << 18
WINDOW = 40
STEPS = 60
#: Limits of the likelihood-ratio test: its statistic, and how many times likelier the feature is in toxic documents.
STATISTIC, RATIO = 20.0, 6.0
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def beginnings(word: str) -> list[str]:
    """The word itself and its beginnings, marked apart."""
    return ["=" + word, *("^" + word[:k] for k in range(3, min(8, len(word)) + 1))]


def features(word: str) -> list[int]:
    word = word.lower()
    names = [*beginnings(word), "^" + word[:2], *(word[-k:] + "$" for k in (2, 3, 4)), f"#{min(len(word), 12)}", ""]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names]


def statistic(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio of a of n against b of m."""

    def of(k: int, total: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((total - k) * math.log(1 - p) if total > k else 0.0)

    p = (a + b) / (n + m)
    return 2 * (of(a, n, a / n) + of(b, m, b / m) - of(a, n, p) - of(b, m, p)) if 0 < p < 1 else 0.0


def lexicon(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, bool]:
    """For words of toxic documents whether they are toxic, by the longest of their beginnings that tells."""
    n, m = len(toxic), len(clean)
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for doc in toxic:
        counts[0].update({f for w in doc for f in beginnings(w)})
    for doc in clean:  # only what toxic documents have is ever asked for
        counts[1].update({f for w in doc for f in beginnings(w) if f in counts[0]})

    marked: dict[str, bool | None] = {}

    def tells(f: str) -> bool | None:
        """True or False, or None where too few documents have the feature."""
        if f not in marked:
            a, b = counts[0][f], counts[1][f]
            high = a * m >= RATIO * max(b, 0.5) * n
            marked[f] = True if high and statistic(a, n, b, m) >= STATISTIC else False if b * n >= a * m and b >= 3 else None
        return marked[f]

    out = {}
    for word in {w for doc in toxic for w in doc}:
        own, *rest = beginnings(word)
        out[word] = next((bool(t) for f in (own, *reversed(rest)) if (t := tells(f)) is not None), False)
    return out


@dataclass
class Model:
    """Log-odds of features, chain potentials relative to clean-clean (start, in, out, stay) and the score's curve."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES, np.float32))
    chain: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    curve: tuple[float, float, float] | None = None  # None: no model, every score is 0


class WordOdds(dict):
    """exp of a word's emission score, kept for words that came before."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.weight = model.weights.tolist().__getitem__

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[word] = odds = math.exp(max(-30.0, min(30.0, sum(map(self.weight, features(word))))))
        return odds


def marginals(odds: list[float], model: Model) -> tuple[list[float], float, float]:
    """Odds of toxic for every token by forward-backward, their maximum and the sum of the marginals."""
    start, enter, leave, stay = (math.exp(x) for x in model.chain)
    ahead, r = [], 0.0
    for t, w in enumerate(odds):
        r = w * (enter + stay * r) / (1.0 + leave * r) if t else w * start
        ahead.append(r)
    most, total, q, out = 0.0, 0.0, 1.0, []
    for w, r in zip(reversed(odds), reversed(ahead), strict=True):
        z = r * q
        out.append(z)
        if z > most:
            most = z
        total += z / (1.0 + z)
        q *= w
        q = (leave + stay * q) / (1.0 + enter * q)
    return out[::-1], most, total


def evidence(most: float, total: float) -> tuple[float, float]:
    return max(-12.0, min(12.0, math.log(max(most, 1e-12)))), math.log(total + 1e-3)


def score(most: float, total: float, model: Model) -> float:
    if model.curve is None:
        return 0.0
    a, b, c = model.curve
    x, y = evidence(most, total)
    return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, a + b * x + c * y))))


def _chain(types: np.ndarray, gold: np.ndarray, feats: np.ndarray) -> Model:
    """Fit weights and chain to windows (rows of word numbers, -1 past the end) with Adam on the conditional likelihood."""
    n, length = types.shape
    there = types >= 0
    w, chain = np.zeros(FEATURES), np.zeros(4)
    w[zlib.crc32(b"") % FEATURES] = -2.0
    first, second = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    # What the labels have of each parameter.
    y = gold & there
    pairs = there[:, 1:]
    have = np.array([y[:, 0].sum(), (~y[:, :-1] & y[:, 1:] & pairs).sum(), (y[:, :-1] & ~y[:, 1:] & pairs).sum(), (y[:, :-1] & y[:, 1:]).sum()], float)
    for step in range(1, STEPS + 1):
        odds = np.exp(np.clip(np.append(w[feats].sum(axis=1), 0.0)[types], -30, 30))
        start, enter, leave, stay = np.exp(chain)
        ahead, behind = np.zeros((n, length)), np.ones((n, length))
        r = odds[:, 0] * start
        ahead[:, 0] = r
        for t in range(1, length):
            r = odds[:, t] * (enter + stay * r) / (1 + leave * r)
            ahead[:, t] = r
        for t in range(length - 2, -1, -1):
            x = odds[:, t + 1] * behind[:, t + 1]
            behind[:, t] = np.where(there[:, t + 1], (leave + stay * x) / (1 + enter * x), 1.0)
        z = ahead * behind
        p = np.where(there, z / (1 + z), 0.0)
        # Marginals of neighbours: proportional to ahead * potential * odds * behind, clean-clean being 1.
        x = odds[:, 1:] * behind[:, 1:]
        into, out, both = enter * x, leave * ahead[:, :-1], stay * ahead[:, :-1] * x
        norm = 1 + into + out + both
        expected = np.array([p[:, 0].sum(), *((part / norm)[pairs].sum() for part in (into, out, both))])
        by_type = np.bincount(types[there], (p - y)[there], len(feats))
        grad = np.append(np.bincount(feats.ravel(), np.repeat(by_type, feats.shape[1]), FEATURES) + 1.0 * w, expected - have + 1.0 * chain)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.25 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, chain = w - move[:-4], chain - move[-4:]
    return Model(w.astype(np.float32), tuple(chain.tolist()))


def fit(sample: list[tuple[str, int]]) -> Model:
    """A model from labelled texts: two thirds make lexicon and chain, one third the curve."""
    one: dict[str, str] = {}  # a single object for each word, which keeps the sample small
    docs = [([one.setdefault(w, w) for w in map(str.lower, words(text))], int(label == 1)) for text, label in sample]
    learn, hold = [d for k, d in enumerate(docs) if k % 3], docs[::3]
    toxic, clean = ([set(ws) for ws, y in learn if y == label] for label in (1, 0))
    if not toxic or not clean or not 0 < sum(y for _, y in hold) < len(hold):
        return Model()
    marks = lexicon(toxic, clean)
    numbers: dict[str, int] = {}
    rows, gold = [], []
    for k, (low, y) in enumerate(learn):
        bad = [y == 1 and marks.get(w, False) for w in low]
        starts = [max(0, i - WINDOW // 2) for i, b in enumerate(bad) if b] if any(bad) else [] if y else [zlib.crc32(str(k).encode()) % max(1, len(low) - WINDOW)]
        if not y:  # words of clean documents that look like toxic ones
            starts += [max(0, i - WINDOW // 2) for i, w in enumerate(low) if marks.get(w)][:CLEAN_WINDOWS]
        past = -1
        for at in starts[:WINDOWS]:
            if at < past:
                continue
            past = at + WINDOW
            some = low[at:past]
            if some:
                rows.append([numbers.setdefault(w, len(numbers)) for w in some] + [-1] * (WINDOW - len(some)))
                gold.append(bad[at:past] + [False] * (WINDOW - len(some)))
    if not rows:
        return Model()
    width = max(len(features(w)) for w in numbers)
    feats = np.array([f + [FEATURES - 1] * (width - len(f)) for f in map(features, numbers)])
    model = _chain(np.array(rows), np.array(gold), feats)
    odds = WordOdds(model)
    x = np.array([(1.0, *evidence(*marginals([odds[w] for w in ws], model)[1:])) for ws, _ in hold])
    y = np.array([y for _, y in hold], float)
    theta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (p - y) + 0.1 * theta)
    model.curve = tuple(theta.tolist())
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample; docs and labels are what may be learnt from, by doc_id."""
    label = F.col("toxic") == 1
    some = [labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(cond).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for cond, n in ((label, TOXIC), (~label, CLEAN))]
    ids = F.broadcast(some[0].union(some[1]))  # TOXIC + CLEAN rows at most
    found = docs.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "toxic").distinct()
    # A doc_id may have any number of texts; what reaches the driver is bounded before it does.
    rows = found.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "toxic", "text").limit(TOXIC + CLEAN).collect()
    return fit([(r.text, r.toxic) for r in rows])


def scores(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of every document (all, unless given) with score, predicted and spans (start, end in code points)."""
    results = ["score", "predicted", "spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results]
    n, names = len(keep), [*keep, *results]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = WordOdds(model)
        for batch in batches:
            out, spans = [], []
            for value in batch.column(at):
                text = value.as_py()
                each, most, total = marginals(list(map(odds.__getitem__, words(text))), model)
                out.append(score(most, total, model))
                spans.append([{"start": m.start(), "end": m.end()} for m, z in zip(_WORD.finditer(text), each, strict=True) if z > 1] if most > 1 else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32()), pa.array(spans, span)], names)

    read, at = with_text(docs, keep)
    return read.mapInArrow(scored, ", ".join([*kinds(read, keep), "score double, predicted int, spans array<struct<start:int,end:int>>"]))
