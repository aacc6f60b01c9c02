"""Benchmark decontamination with suffix arrays over the training words.

A task cuts its documents into shards of words and sorts a shard's suffixes (those that begin with a word of the
benchmark; no other can match anything) by their first DEPTH words, by doubling the compared length.  Every suffix of
every benchmark item is then looked up by binary search, all of them at once; the ranges found are the occurrences of
its window, and windows that follow each other on both sides join to the longest verbatim match.

The benchmark is read in blocks of bounded size.  CHAIN of them go through the documents in one pass, each in its own
step of the same tasks; if there are more, what a pass found is written and the next pass goes on from there.  So the
driver and a task hold CHAIN blocks, one more while they are made, and a shard, whatever the benchmark's and the
table's size, and nothing is shuffled.

Words: A-Z lower-cased, then runs of letters a-z, digits and all characters from U+0080.  A window is ``width``
consecutive words of an item, or the whole item if it has fewer.  Defined results: null or empty text has no words and
no hits; a benchmark row without words has no windows, one without id has windows that hit but is no item; rows that
repeat an item_id are parts of one item; repeated documents are judged alike; empty tables give no rows or no hits;
columns of the documents that are named as the results are replaced by scan, and kept by decontaminate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvello.llm.common import discard, hidden, kinds, materialise, with_text

WIDTH = 10
DEPTH = 16
#: Words of a shard, or those of one longer document: some 30 MB while it is sorted.
SHARD_WORDS = 1 << 18
#: Words of a block of the benchmark, which is sent with the tasks: some 20 MB.
BLOCK_WORDS = 1 << 19
#: Blocks that go through the documents in one pass.
CHAIN = 4

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Block:
    """Some benchmark items: their vocabulary, and their suffixes as rows of DEPTH word numbers, 0 past the end."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int = WIDTH) -> None:
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        rows, lengths, of, at = [], [], [], []
        for k, (_, ws) in enumerate(items):
            ids = np.array([self.vocabulary[w] for w in ws] + [0] * DEPTH, np.int32)
            n = min(width, len(ws))
            starts = np.arange(len(ws) - n + 1)
            rows.append(ids[starts[:, None] + np.arange(DEPTH)])
            lengths.append(np.full(len(starts), n))
            of.append(np.full(len(starts), k))
            at.append(starts)
        self.items = [item for item, _ in items]
        self.rows = np.concatenate([np.empty((0, DEPTH), np.int32), *rows])
        self.width, self.of, self.at = (np.concatenate([np.empty(0, int), *x]) for x in (lengths, of, at))


def blocks(benchmark: DataFrame, width: int = WIDTH) -> Iterator[Block]:
    """The benchmark in blocks of BLOCK_WORDS words or one longer item, made one after the other."""
    items, n = [], 0
    for row in benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if ws := words(row.text):
            if n and n + len(ws) > BLOCK_WORDS:
                yield Block(items, width)
                items, n = [], 0
            items.append((row.item_id, ws))
            n += len(ws)
    yield Block(items, width)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of suffixes of ``ids`` (0: no word of the benchmark) that begin with another number than 0, by their first DEPTH numbers."""
    starts = np.flatnonzero(ids)
    rank = ids.astype(np.int64)
    compared = 1
    while compared < DEPTH:
        after = np.zeros(len(ids), np.int64)
        after[:-compared] = rank[compared:]
        key = rank[starts] * (int(rank.max(initial=0)) + 1) + after[starts]
        _, found = np.unique(key, return_inverse=True)
        rank = np.zeros(len(ids), np.int64)
        rank[starts] = found + 1
        compared *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def search(ids: np.ndarray, order: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (suffix of the block, place in ids) where the suffix's window occurs."""
    text = np.concatenate([ids, np.zeros(DEPTH, np.int32)])
    columns = np.arange(DEPTH)
    bounds = []
    for past in (-1, np.iinfo(np.int32).max):
        wanted = np.where(columns < block.width[:, None], block.rows, past)
        low, high = np.zeros(len(wanted), int), np.full(len(wanted), len(order))
        while (open_ := low < high).any():
            rows = np.flatnonzero(open_)
            middle = (low[rows] + high[rows]) // 2
            there, want = text[order[middle][:, None] + columns], wanted[rows]
            first = (there != want).argmax(axis=1)
            n = np.arange(len(rows))
            less = there[n, first] < want[n, first]
            low[rows[less]] = middle[less] + 1
            high[rows[~less]] = middle[~less]
        bounds.append(low)
    n = bounds[1] - bounds[0]
    suffix = np.repeat(np.arange(len(n)), n)
    place = order[np.repeat(bounds[0] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    return suffix, place


class _Shard:
    """Documents whose words are looked up together; what is found of each is (hit intervals, item ids, longest match, its start)."""

    def __init__(self, block: Block) -> None:
        self.block, self.parts, self.lengths = block, [], []

    def add(self, ws: list[bytes]) -> None:
        get = self.block.vocabulary.get
        self.parts.append(np.array([get(w, 0) for w in ws] + [0], np.int32))
        self.lengths.append(len(ws))

    def results(self) -> list[tuple[list[int], set[str], int, int]]:
        none = [([], set(), 0, -1)] * len(self.parts)
        if not self.parts or not len(self.block.rows):
            return none
        ids, block = np.concatenate(self.parts), self.block
        begins = np.cumsum([0, *(len(p) for p in self.parts)])
        suffix, place = search(ids, suffix_array(ids), block)
        if not len(suffix):
            return none
        # Windows of one item that follow each other at the same distance are one verbatim match.
        of = block.of[suffix]
        order = np.lexsort((place, place - block.at[suffix], of))
        suffix, place, of = suffix[order], place[order], of[order]
        diagonal = place - block.at[suffix]
        new = np.ones(len(place), bool)
        new[1:] = (of[1:] != of[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        start, length, item = place[first], place[last] - place[first] + block.width[suffix[first]], of[first]
        doc = np.searchsorted(begins, start, "right") - 1
        out = list(none)
        for d in np.unique(doc):
            mine = np.flatnonzero(doc == d) if len(doc) < 1000 else self._of(doc, d)
            spans = sorted(zip((start[mine] - begins[d]).tolist(), (start[mine] - begins[d] + length[mine]).tolist(), strict=True))
            best = max(spans, key=lambda s: (s[1] - s[0], -s[0]))
            out[d] = (merged(spans), {block.items[k] for k in np.unique(item[mine]).tolist()} - {None}, best[1] - best[0], best[0])
        return out

    def _of(self, doc: np.ndarray, d: int) -> np.ndarray:
        if not hasattr(self, "_sorted"):
            self._order = np.argsort(doc, kind="stable")
            self._sorted = doc[self._order]
        return self._order[np.searchsorted(self._sorted, d) : np.searchsorted(self._sorted, d, "right")]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted spans without overlaps, flat."""
    out: list[int] = []
    for a, b in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


RESULTS = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "longest_match": pa.int64(), "longest_start": pa.int64()}
_STATE = {"__hits": pa.list_(pa.int64()), "__items": pa.list_(pa.string()), "__longest": pa.int64(), "__start": pa.int64()}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, width: int = WIDTH, text: str = "text") -> DataFrame:
    """Columns ``keep`` of every document (all, unless given), with what of the benchmark occurs in it."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    frame, at = with_text(docs, keep, text)
    base, held, read, written = frame.columns, blocks(benchmark, width), 0, None
    block = next(held)
    while block:
        after = next(held, None)
        names, found = (keep, RESULTS) if after is None else (base, _STATE)
        step = _step(block, at, len(base) if read else 0, len(names), after is None, [*names, *found])
        frame = frame.mapInArrow(step, ", ".join([*kinds(frame, names), *(f"{n} {_SQL[t]}" for n, t in found.items())]))
        read, block = read + 1, after
        if after and read % CHAIN == 0:
            before, written = written, materialise(frame, "hits")
            discard(before)
            frame = written
    return frame


def _step(block: Block, at: int, state: int, n: int, last: bool, names: list[str]):
    """A task's pass with one block: the text is column ``at``, what earlier steps found begins at ``state`` (0: nothing
    yet), and the first ``n`` columns go on."""

    def finished(held: list[pa.RecordBatch], shard: _Shard) -> Iterator[pa.RecordBatch]:
        found, k = shard.results(), 0
        for batch in held:
            mine, counts = found[k : k + batch.num_rows], shard.lengths[k : k + batch.num_rows]
            k += batch.num_rows
            if state:
                mine = [joined(x, y) for x, y in zip(mine, zip(*(c.to_pylist() for c in batch.columns[state:]), strict=True), strict=True)]
            if last:
                items = [sorted(x[1]) for x in mine]
                hits = [sum(x[0][1::2]) - sum(x[0][::2]) for x in mine]
                columns = [counts, hits, [len(x) for x in items], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], [h > 0 for h in hits], [x[2] for x in mine], [x[3] if x[2] else None for x in mine]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, t) for c, t in zip(columns, RESULTS.values(), strict=True))], names)
            else:
                columns = [[x[0] for x in mine], [sorted(x[1]) for x in mine], [x[2] for x in mine], [x[3] for x in mine]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, t) for c, t in zip(columns, _STATE.values(), strict=True))], names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, size = [], _Shard(block), 0
        for batch in batches:
            begin = 0
            for k, text in enumerate(batch.column(at)):
                ws = words(text.as_py())
                shard.add(ws)
                size += len(ws)
                if size >= SHARD_WORDS:
                    yield from finished([*held, batch.slice(begin, k + 1 - begin)], shard)
                    held, shard, size, begin = [], _Shard(block), 0, k + 1
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield from finished(held, shard)

    return step


def joined(a: tuple, b: tuple) -> tuple:
    """Findings of one document by two blocks."""
    spans = sorted([*zip(a[0][::2], a[0][1::2]), *zip(b[0][::2], b[0][1::2])])
    best = max((a, b), key=lambda x: (x[2], -x[3]))
    return merged(spans), {*a[1], *b[1]}, best[2], best[3]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs."""
    frame, text, columns = hidden(docs)
    return scan(frame, benchmark, frame.columns, width, text).where("NOT contaminated").select(*columns)
