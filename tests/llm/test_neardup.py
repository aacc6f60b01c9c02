"""Groups against brute force over full shingle sets, and defined edge cases."""

import math
import random
from collections import Counter, defaultdict

from corvello.llm import neardup


def brute(rows):
    """doc_id: (set size, least doc_id of its component), by comparing all that share a shingle of their rarest."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held, counts = defaultdict(list), Counter(t for s in sets.values() for t in s)
    for i in sorted(sets, key=lambda i: len(sets[i])):
        prefix = sorted(sets[i], key=lambda t: (counts[t], t))[: len(sets[i]) - math.ceil(0.75 * len(sets[i])) + 1]
        for j in {j for t in prefix for j in held[t]}:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for t in prefix:
            held[t].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), (r, want[r.doc_id])


def test_documents(spark, documents):
    check(spark, [(r["doc_id"], r["text"]) for r in documents])


def test_families_passages_and_short_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    passage, rows = [word() for _ in range(60)], []
    for family in range(4):
        base = [word() for _ in range(rng.randrange(40, 200))]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randrange(12)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(rng.randrange(5, 60))] + passage) for _ in range(80)]
    rows += ["one two", "One  TWO", "one two", "", "  \n", None, "é ü", rows[0], rows[0].upper()]
    check(spark, list(enumerate(rows)))


def test_edges(spark):
    assert neardup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "a b c d e f g h"
    rows = [(5, text, "x"), (5, text, "y"), (None, text, "z"), (None, None, "w"), (3, text + " \n", "v"), (9, "word " * 30_000, "u")]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 4, 3, False), (3, 4, 3, True), (5, 4, 3, False), (5, 4, 3, False), (9, 1, 9, True)]


def test_repeated_ids_in_any_order(spark):
    rng = random.Random(4)
    a, c = (" ".join(f"{x}{rng.randrange(1000)}" for _ in range(80)) for x in "ac")
    rows = [(1, a), (1, c), (2, a + " more"), (3, None), (3, "x y"), (4, c + " end")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 1)]


def test_a_family_that_its_leader_does_not_hold(spark):
    # A chain: each text differs from the one before it in a few words, so ends are far from each other.
    rng = random.Random(6)
    words, rows = [f"w{rng.randrange(10_000)}" for _ in range(120)], []
    for i in range(150):
        words[(i * 2) % 120] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {v[1] for v in brute(rows).values()}
    check(spark, rows)


def test_blocks_of_several_members(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 4)
    test_families_passages_and_short_texts(spark)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(8, 60)}}
