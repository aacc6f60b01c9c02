"""Language ID, neighbours, toxicity, packing, licences and WARC: brute force, round trips, held-out accuracy, edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from corvello.llm import ann, language_id, license_scan, packing, queries, toxicity, warc

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = queries.op1_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_vectors_and_edges(spark):
    a, b, c = language_id.letter_vectors()
    grams = language_id.trigrams("Ab")
    assert [(g >> 12, g >> 6 & 63, g & 63) for g in grams.tolist()] == [(0, 1, 2), (1, 2, 0)]
    assert (language_id.trigram_vectors(grams)[0] == a[0] * b[1] * c[2]).all()
    cached = language_id._Vectors(most=3)
    many = np.arange(0, 200, 7, dtype=np.int32)
    assert (cached(many) == language_id.trigram_vectors(many)).all() and (cached(many[:2]) == cached(many[:2])).all()
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "text", None)]
    langs, profiles = language_id.prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["de", "en"] and np.allclose(np.linalg.norm(profiles, axis=1), 1)
    asked = [(1, "THE CAT!!", 9.0), (1, "THE CAT!!", 9.0), (2, "12 %%", None), (3, None, None), (None, "", None), (5, "die katze " * 20_000, None), (6, "Ελλ", None)]
    frame = spark.createDataFrame(asked, "doc_id long, text string, score double")
    got = language_id.identify(frame, langs, profiles).collect()
    assert [r.lang_pred for r in got[:6]] == ["en", "en", "und", "und", "und", "de"] and got[6].score >= 0
    assert [r.lang_pred for r in language_id.identify(frame, [], np.empty((0, language_id.DIMENSIONS))).collect()] == ["und"] * 7
    assert language_id.identify(frame.limit(0), langs, profiles).count() == 0


def test_neighbours_recall(spark):
    got = queries.op2_hnsw(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        near = v @ v[ids == q][0]
        want = [i for _, i in sorted((-s, i) for s, i in zip(near, ids, strict=True) if i != q)][:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(math.isclose(r.score, near[ids == r.vec_id][0], abs_tol=1e-12) for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(want)), total + 5
    assert hits >= 0.9 * total


def test_neighbours_edges(spark):
    rng = np.random.default_rng(0)
    copies = [(i, [1.0, 0.0, 0.5]) for i in range(100, 140)]
    rows = copies + [(i, rng.normal(size=3).tolist()) for i in range(1, 40)] + [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]), (205, []), (None, [1.0, 1.0, 1.0]), (300, [1.0, 2.0]), (301, [2.0, 4.0])]
    found = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.nearest(found, found.where("vec_id IN (100, 139, 300)")).orderBy("query_id", "rank").collect()
    by = {q: [r.vec_id for r in got if r.query_id == q] for q in (100, 139, 300)}
    assert by == {100: [101, 102, 103, 104, 105], 139: [100, 101, 102, 103, 104], 300: [301]}
    assert ann.nearest(found.limit(0), found.limit(0)).count() == 0


def _recall(rows, got, k=5):
    """Share of the true neighbours' scores that were reached, by brute force; rows: (vec_id, unit vector)."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    for q in {r.query_id for r in got}:
        near = v @ v[ids == q][0]
        want = sorted(near[ids != q])[-k:]
        hits, total = hits + sum(r.score >= want[0] - 1e-9 for r in got if r.query_id == q), total + len(want)
    return hits / total


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_over_several_shards(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "LEAST_SHARD", 600)
    monkeypatch.setattr(ann, "SHARD_GROWTH", 1)
    monkeypatch.setattr(ann, "QUERIES", 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24)) * (4 if clustered else 0)
    rows = [(i, (centres[i % 12] + rng.normal(size=24)).tolist()) for i in range(1, 4001)] + [(100, [0.0] * 24)]
    found = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.nearest(found, found.where("vec_id % 50 = 0")).collect()
    assert len(got) == 80 * 5 and _recall(rows[:-1], got) >= 0.9


def test_repeated_queries_and_own_copies(spark):
    rng = np.random.default_rng(5)
    v = [1.0, 0.2, 0.0]
    rows = [(50, v)] * 12 + [(50, [0.0, 1.0, 1.0])] + [(i, v) for i in (60, 40, 70)] + [(i, rng.normal(size=3).tolist()) for i in range(1, 30)]
    found = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.nearest(found, found.where("vec_id = 50")).collect()
    # Two queries: the repeated one, and the same id with another vector.
    assert sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and not any(r.vec_id == 50 for r in got)
    assert [(r["rank"], r.vec_id) for r in sorted(got) if math.isclose(r.score, 1.0)] == [(1, 40), (2, 60), (3, 70)]


def test_toxicity_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(got[r.doc_id], r.toxic) for r in labels if got[r.doc_id].held_out]
    flagged = [y for g, y in held if g.predicted]
    assert all(g.predicted == int(g.score >= 0.7) and 0 <= g.score <= 1 for g in got.values())
    assert sum(flagged) >= 0.9 * len(flagged) and sum(flagged) >= 0.65 * sum(y for _, y in held)


def test_chain_marginals_and_edges(spark):
    model = toxicity.Model(chain=(0.3, -1.0, 0.5, 0.8), curve=(0.0, 1.0, 0.0))
    odds = [0.2, 3.0, 0.5, 1.7]
    start, enter, leave, stay = (math.exp(x) for x in model.chain)
    total, on = 0.0, [0.0] * 4
    for path in range(16):
        y = [path >> k & 1 for k in range(4)]
        p = start if y[0] else 1.0
        for a, b in zip(y, y[1:], strict=False):
            p *= (1.0, enter, leave, stay)[2 * a + b]
        for k in range(4):
            p *= odds[k] if y[k] else 1.0
        total += p
        on = [o + p * k for o, k in zip(on, y, strict=True)]
    got, most, both = toxicity.marginals(odds, model)
    assert np.allclose([z / (1 + z) for z in got], np.array(on) / total) and math.isclose(most, max(got)) and math.isclose(both, sum(on) / total)
    texts = [f"word{'abc'[k % 3]} plain text here {'idiot' if k % 2 else 'fine'} and more {'idiots' if k % 4 == 1 else ''}" for k in range(120)]
    fitted = toxicity.fit([(t, k % 2) for k, t in enumerate(texts)])
    rows = [(1, "such an idiot."), (1, "such an idiot."), (2, "plain fine"), (3, None), (None, ""), (5, "%% 12"), (6, "plain " * 50_000 + "IDIOT")]
    out = toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score"), fitted).collect()
    assert [r.predicted for r in out] == [1, 1, 0, 0, 0, 0, 1] and [(s.start, s.end) for s in out[0].spans] == [(8, 13)] and out[6].spans[0].end == 300_005
    assert toxicity.fit([]).curve is None and toxicity.fit([("a", 1)] * 9).curve is None
    assert [r.score for r in toxicity.scores(spark.createDataFrame(rows[:1], "doc_id long, text string"), toxicity.Model()).collect()] == [0.0]


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(r["doc_id"], r["text"]) for r in documents] + [(9001, None), (9002, ""), (9003, "\x1c odd space <|endoftext|> don't İ"), (9004, "long words " * 6000), (9004, "long words " * 6000), (9005, "a<|startoftext|>b <|endoftext|><|endoftext|> x <|ENDOFTEXT|>"), (None, "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length"), queries.tokenizer_path()).collect()
    want = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i or 0, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for at in range(0, len(ids), 2048)]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= 1.02 * sum(r.length for r in got) / 2048 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 65): rng.randrange(1, 200) for _ in range(rng.randrange(1, 40))}
    slots, n = packing.plan(histogram, 64)
    filled = {}
    for length, first, each, sequence, offset in slots.tolist():
        later = [s[1] for s in slots.tolist() if s[0] == length and s[1] > first]
        for r in range(min(later, default=histogram[length]) - first):
            filled.setdefault(sequence + r // each, []).append((offset + r % each * length, length))
    assert len(filled) == n and sum(map(len, filled.values())) == sum(histogram.values())
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and sum(length > 64 // 3 for _, length in pieces) <= 2
    assert n <= max(1.35 * sum(k * v for k, v in histogram.items()) / 64 + 1, sum(v for k, v in histogram.items() if k > 32))


def test_licences(spark):
    got = {r.doc_id: r for r in queries.op8_license_scan(spark, SF).collect()}
    wanted = {"Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT", "GNU General Public License": "GPL", "CC BY-NC": "CC-BY-NC", "All rights reserved": "Proprietary"}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        families = {f for t, f in wanted.items() if t in r.text}
        assert (got[r.doc_id].family in families and got[r.doc_id].confirmed) if families else got[r.doc_id].family is None, r.doc_id
    model = license_scan.fit(["plain text of no kind", "another one with the words of a paragraph"] * 50)
    rows = [(1, None), (2, ""), (3, "x\nLICENSED### under the Apache### License,&& Version 2.0\ny"), (3, "the license"), (None, "Released under the MIT License"), (5, "word " * 50_000 + "\nAll rights reserved."), (6, "GNU version license apache mit")]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row"), model).collect()
    assert sorted((r.doc_id or 0, r.family or "") for r in out if r.confirmed or not r.family) and {(r.doc_id, r.family) for r in out if r.confirmed} == {(3, "Apache-2.0"), (None, "MIT"), (5, "Proprietary")}
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    big = "é" * 200_000
    rows = [(1, "http://a/ b\n", "same"), (7, "u", "same"), (7, "u2", "same"), (3, None, None), (4, None, ""), (5, "u", big), (None, "u", "same"), (None, "u", "alone"), (9, "u", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS sha1")
    index = warc.write_archives(pages)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0, r.payload_digest) for r in warc.read_archives(spark, index).collect()), key=str)
    want = [(0, 4, "revisit", 7), (0, 5, "response", 0), (1, 4, "revisit", 7), (3, 0, "revisit", 4), (4, 0, "response", 0), (5, 400_000, "response", 0), (7, 4, "response", 0), (7, 4, "response", 0), (9, 3, "response", 0)]
    assert sorted((g[:4] for g in got), key=str) == sorted(want, key=str)
    assert {g[4] for g in got if g[1] == 4} == {warc.base32_digest(b"same")}
    import pyarrow.fs as pafs

    for r in index.collect():  # by the index alone
        fs, path = pafs.FileSystem.from_uri(r.bundle)
        head, _, payload, end = warc.BundleReader(fs, path).record(r.frame, r.offset)
        assert head["WARC-Record-ID"] == f"<{r.record_id}>" and end - r.offset == r.length
        if r.page_id == 5:
            assert payload.decode() == big
    small = warc.read_archives(spark, warc.write_archives(pages, min_revisit_bytes=5)).where("record_type = 'revisit'").count()
    assert small == 0 and warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_warc_frames_are_plain_zstandard(spark, tmp_path):
    import pyarrow.fs as pafs
    import zstandard

    writer = warc.BundleWriter(pafs.LocalFileSystem(), str(tmp_path / "b.zst"))
    records = [warc.record_bytes(i, "u", bytes([65 + i]) * 900_000, "D", None) for i in range(4)]
    for i, r in enumerate(records):
        writer.add(i, r)
    writer.close()
    whole = zstandard.ZstdDecompressor().stream_reader((tmp_path / "b.zst").open("rb"), read_across_frames=True).read()
    assert whole == b"".join(records) and len(writer.sizes) == 4


def test_wrapped_licences(spark):
    model = license_scan.fit(["plain text of no kind", "another one with the words of a paragraph"] * 50)
    bsd = "/*\n * Some title\n *\n * Redistribution and use in source and binary\n * forms, with or without modification, are\n * permitted provided that the following\n * conditions are met:\n *\n * the code\n */\nint x;"
    gpl = "# This program is free software: you can\n# redistribute it and/or modify it under the terms\n# of the GNU General Public License as published\n# by the Free Software Foundation, either version 3\n# of the License, or (at your option) any later\n# version."
    mit = "plain text\n\nReleased under\nthe MIT\nLicense\r\n \r\nmore text"
    two = "Released under the MIT License\nAll rights reserved."
    frame = spark.createDataFrame(list(enumerate([bsd, gpl, mit, two, "forms of text\n\nwith words"])), "doc_id long, text string")
    got = {r.doc_id: (r.family, r.confirmed, r.n_paragraphs) for r in license_scan.scan(frame, model).collect()}
    assert [got[k] for k in range(3)] == [("BSD", True, 1), ("GPL", True, 1), ("MIT", True, 1)] and got[3][1:] == (True, 2) and not got[4][1]


def _licences(text, model):
    """family, probability, confirmed and paragraphs of a text by plain Python."""
    known, templates = set(model.vocabulary), {f: [set(license_scan.plain_words(t)) & set(model.vocabulary) for t in ts] for f, ts in license_scan.TEMPLATES.items()}

    def judged(words):
        found = set(license_scan.ngrams(words)) & set(model.weights)
        if not found:
            return None
        z = [(sum(model.weights[f][k] for f in found) + b) / model.temperature for k, b in enumerate(model.bias)]
        best = max(range(len(z) - 1), key=lambda k: (z[k], -k))
        p = math.exp(z[best]) / sum(map(math.exp, z))
        share = max((len(t & set(words)) / len(t) for t in templates[model.classes[best]] if t), default=0)
        return (model.classes[best], p, share >= license_scan.CONFIRMED) if p >= license_scan.PROBABILITY else None

    out, place = [], 0
    for block in re.split(r"\n(?:[^a-zA-Z0-9\u00c0-\uffff\n]*\n)+", text or ""):
        lines = []
        for line in block.split("\n"):
            words = [w for w in license_scan.plain_words(line) if w in known]
            if words:
                lines.append((place, words))
                place += 1
        single = [(k, j) for k, ws in lines if (j := judged(ws)) and j[2]]
        out += single
        rest = [(k, ws) for k, ws in lines if k not in {k for k, _ in single}]
        if rest and (j := judged([w for _, ws in rest for w in ws])):
            out.append((rest[0][0], j))
    if not out:
        return None, 0.0, False, 0
    k, best = max(out, key=lambda x: (x[1][2], x[1][1], -x[0]))
    return (*best, len(out))


def test_licence_scores_equal_plain_python(spark):
    rng = random.Random(12)
    model = license_scan.fit(["plain text of no kind", "another one with the words of a paragraph"] * 50)
    notices = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    texts = []
    for _ in range(150):
        words = " ".join(license_scan.damaged(rng.choice(notices), rng) for _ in range(rng.randrange(1, 3))).split()
        texts.append("".join(w + rng.choice([" ", " ", " ", " ", "\n", "\n\n", "\n// \n"]) for w in words))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        family, p, confirmed, n = _licences(text, model)
        r = got[k]
        assert (r.family, r.confirmed, r.n_paragraphs) == (family, confirmed, n) and math.isclose(r.probability, p, abs_tol=1e-9), (text, r, family, p)
