"""Best-fit packing of tokenised documents into sequences of a fixed capacity (large-item matching).

Pieces of equal length are interchangeable, so the plan is made on the histogram of piece lengths, which has at most
``capacity`` entries whatever the input's size.  Pieces above a third of the capacity come first: the longest one left
is matched with the longest other one that still fits beside it, so a sequence has two of them at most.  The smaller
ones then go, longest first, where they leave the smallest gap; new sequences are opened when no gap is wide enough.
The plan is a list of runs of alike sequences.  Pieces are numbered within their length (salted, so that a length that
a third of all pieces share is numbered by many tasks) and look up their place in the plan by that number.

Texts are tokenised as the tokenizer does by default, so the strings of its special tokens become these tokens.

Defined results: null text counts as empty; an empty text is the end token alone; of documents of the same doc_id each
row is packed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvello.llm.common import discard, materialise, with_text

CAPACITY = 2048
END_ID = 0
#: Pieces of one length and salt on average at most.
ROWS_A_BUCKET = 2000
#: Entries of a worker's cache of chunks; a full cache is emptied.
CACHE_ENTRIES = 150_000

#: White space other than blank, tab and line ends: whether the tokenizer's library takes it as such is left to it.
_ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
#: A run of Latin letters (whose lower case has as many letters) is one word to the tokenizer, and so is a run of this punctuation.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|$%&#*]*)")


#: How byte-level tokenizers write the bytes of 128 and above that are no printable letters of Latin-1.
_BYTE_LETTERS = {b: 256 + 33 + k for k, b in enumerate([*range(0x7F, 0xA1), 0xAD])}


class ChunkTokenizer:
    """Ids of texts as little-endian 32-bit numbers; what stands between white space is tokenised once and kept.

    Latin words are kept apart, so that a word is tokenised once whatever its case and the punctuation after it; they
    need no more than the tokenizer's model, which takes bytes as letters.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a lower-case Latin word or of a run of punctuation."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > CACHE_ENTRIES:
                self.words = {"": b""}
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            self.words[word] = found = self.packed([t.id for t in self.tokenizer.model.tokenize(letters)])
        return found

    def learn(self, chunks: set[str]) -> None:
        """Put chunks into the cache."""
        odd, match, word, cache = [], _WORD.fullmatch, self.word, self.cache
        for chunk in chunks:
            if m := match(chunk):
                cache[chunk] = word(m[1].lower()) + word(m[2])
            else:
                odd.append(chunk)
        for at in range(0, len(odd), 20_000):
            some = odd[at : at + 20_000]
            for chunk, enc in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                cache[chunk] = self.packed(enc.ids)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 200):
            chunks = [None if t and _ODD_SPACE.search(t) else (t or "").split() for t in texts[at : at + 200]]
            new = set().union(*(c for c in chunks if c)) - self.cache.keys()
            if len(self.cache) + len(new) > CACHE_ENTRIES:
                self.cache.clear()
                new = set().union(*(c for c in chunks if c))
            self.learn(new)
            get = self.cache.__getitem__
            for text, parts in zip(texts[at : at + 200], chunks, strict=True):
                yield self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids) if parts is None else b"".join(map(get, parts))


@lru_cache(1)
def shared_tokenizer(path: str) -> ChunkTokenizer:
    """One for all tasks that a worker runs."""
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, end = shared_tokenizer(tokenizer_path), ChunkTokenizer.packed([END_ID])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            of, piece, start, length, crc = [], [], [], [], []
            for i, coded in enumerate(tokenize(texts)):
                coded += end
                n = len(coded) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    of.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    crc.append(zlib.crc32(coded[4 * at : 4 * (at + capacity)]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_text(docs, ["doc_id"])[0].mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Slots (length, first number, pieces a sequence, first sequence, offset) sorted by length and number; sequences.

    Piece number r of a length goes into its slot with the largest first number f <= r, as number (r - f) there.
    """
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    third = capacity // 3
    runs: dict[int, list[tuple[int, tuple]]] = {}  # by gap: sequences of a run and the (length, count) in each

    def add(gap: int, n: int, content: tuple) -> None:
        if n:
            runs.setdefault(gap, []).append((n, content))

    for x in range(capacity, third, -1):
        y = min(x, capacity - x)
        while left[x]:
            while y > third and (not left[y] or (y == x and left[x] < 2)):
                y -= 1
            if y <= third:
                add(capacity - x, left[x], ((x, 1),))
                left[x] = 0
            elif y == x:
                add(capacity - 2 * x, left[x] // 2, ((x, 2),))
                left[x] %= 2
            else:
                n = min(left[x], left[y])
                add(capacity - x - y, n, ((x, 1), (y, 1)))
                left[x] -= n
                left[y] -= n
    for x in range(third, 0, -1):
        for gap in range(x, capacity + 1):
            if not left[x]:
                break
            if gap == capacity:
                runs.setdefault(gap, []).append((-(-left[x] // (gap // x)), ()))
            each = gap // x
            while left[x] and runs.get(gap):
                n, content = runs[gap].pop()
                full, rest = divmod(min(left[x], n * each), each)
                left[x] -= full * each + rest
                add(gap - each * x, full, (*content, (x, each)))
                if rest:
                    add(gap - rest * x, 1, (*content, (x, rest)))
                add(gap, n - full - (rest > 0), content)
    slots, used, sequences = [], [0] * (capacity + 1), 0
    for gap in sorted(runs):
        for n, content in runs[gap]:
            offset = 0
            for x, each in content:
                slots.append((x, used[x], each, sequences, offset))
                used[x] += n * each
                offset += x * each
            sequences += n
    return np.array(sorted(slots), np.int64).reshape(-1, 5), sequences


def numbered(cut: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Pieces with their number among those of their length, from 0; a frequent length is dealt to as many salts as it needs."""
    parts = cut.sparkSession.createDataFrame([(x, math.ceil(n / ROWS_A_BUCKET)) for x, n in histogram.items()], "length long, parts int")
    salted = cut.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts")).drop("parts")
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("number", F.row_number().over(within)).join(before, ["length", "salt"]).withColumn("number", F.col("before") + F.col("number") - 1).drop("salt", "before")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = materialise(pieces(docs, tokenizer_path, capacity), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots, _ = plan(histogram, capacity)
    keys = (slots[:, 0] << 44) | slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(n).to_numpy() for n in ("length", "number"))
            slot = slots[np.searchsorted(keys, (length << 44) | number, "right") - 1]
            nth, at = np.divmod(number - slot[:, 1], slot[:, 2])
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slot[:, 3] + nth), pa.array(slot[:, 4] + at * length)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*names).schema]
    out = materialise(numbered(cut, histogram).mapInArrow(place, ", ".join([*kinds, "sequence_id long, offset long"])), "packed")
    discard(cut)
    return out
