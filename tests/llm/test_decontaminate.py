"""Occurrences against a plain search; several blocks of the benchmark; suffix order; edge cases."""

import hashlib
import re

import numpy as np
import pytest

from corvello.llm import decontaminate as d

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(10, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def run(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.scan(spark.createDataFrame(rows, "doc_id long, text string"), bench, ["doc_id"]).collect()
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got}, got


@pytest.mark.parametrize(("block", "shard"), [(d.BLOCK_WORDS, d.SHARD_WORDS), (250, 3000)])
def test_documents(spark, documents, monkeypatch, block, shard):
    import pyarrow.parquet as pq

    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    monkeypatch.setattr(d, "SHARD_WORDS", shard)
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()]
    rows = [(r["doc_id"], r["text"]) for r in documents]
    # Passages in other clothes: changed case and punctuation, one word short of a window, several items in a document.
    for k, (_, text) in enumerate(items[:12]):
        w = text.split()
        rows += [(10_000 + k, "x " + " -- ".join(w[2:14]).upper()), (11_000 + k, " ".join(w[:9])), (12_000 + k, text + " und " + items[k + 1][1] + " " + text)]
    items += [(900, "Short item, three"), (901, "solo")]
    rows += [(13_000, "a short ITEM three. solo! solo"), (13_001, "short item"), (13_002, "three short item")]
    got, found = run(spark, rows, items)
    for i, text in rows:
        assert got[i] == brute(text, items), i
    assert next(r for r in found if r.doc_id == 12_000).longest_match >= len(words(items[0][1]))


def test_edges(spark):
    items = [(1, "a b c d e f g h i j k"), (1, "z z z z z z z z z z"), (2, None), (None, "q q q q q q q q q q"), (3, ""), (4, "...")]
    rows = [(1, None), (2, ""), (3, "z " * 25), (4, "q " * 10), (5, "y " * 100_000 + "a b c d e f g h i j k"), (6, "a b c d e\x00f g h i j")]
    got, found = run(spark, rows, items)
    none = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, none, False) == got[2] and got[4] == (10, 10, 0, none, True)
    assert got[3][:3] == (25, 25, 1) and got[5][:3] == (100_011, 11, 1) and got[6][:3] == (10, 10, 1)
    longest = {r.doc_id: (r.longest_match, r.longest_start) for r in found}
    assert longest[5] == (11, 100_000) and longest[1] == (0, None)
    assert run(spark, [], items)[1] == [] and run(spark, rows, [])[0][3] == (25, 0, 0, none, False)
    docs = spark.createDataFrame([(1, "z " * 12, 5), (1, "fine", 6), (None, "fine", 7)], "doc_id long, text string, n_hit long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.text, r.n_hit) for r in d.decontaminate(docs, bench).collect()) == [("fine", 6), ("fine", 7)]


def test_suffixes_are_in_order():
    ids = np.random.default_rng(0).integers(0, 3, 500).astype(np.int32)
    text = np.concatenate([ids, np.zeros(d.DEPTH, np.int32)])
    order = d.suffix_array(ids)
    assert sorted(order.tolist()) == np.flatnonzero(ids).tolist()

    def key(p):
        row = text[p : p + d.DEPTH].tolist()
        return row[: row.index(0)] if 0 in row else row

    keys = [key(p) for p in order]
    assert keys == sorted(keys)
