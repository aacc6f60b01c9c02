"""Base spans against the plain patterns; the bootstrapping on a small corpus; edge cases."""

import hashlib
import random
import re

import pytest

from corvello.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (text, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i].spans.split(","))or not want


def test_base_spans_of_documents(spark, documents):
    check(spark, [(r["doc_id"], r["text"]) for r in documents])


def test_base_spans_of_random_texts(spark):
    rng, rows = random.Random(3), []
    for i in range(1500):
        alphabet = rng.choice(["ab@.-_ ", "0123456789.. ", "123 -4", "+12 ().-34 a", "a@b.c_%+1 é\U0001f600\n", "4 -05+@.a"])
        rows.append((i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))))
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "x4111111111111111y", "+4111111111111111", "4111  111111111111", "41111111111111111111111", "1.2.3.4.5.6.7.8", "0000255.1.1.1", "256.1.1.1", "a@b.c@d.e", "a@b.c_x@d.e", "😀é a@b.co", "+1 (743) 555-3824 x", "+1 2 3 4 5 6 7 8 9 )) .", "a@b..c", "a@b.c."]
    check(spark, rows + [(5000 + k, x) for k, x in enumerate(cards)])


def test_edges(spark):
    long = "1." * 20_000 + " " + "a" * 50_000 + "@x" + ".y" * 20_000 + " " + "7 " * 30_000 + "+" + "1 " * 20_000
    check(spark, [(1, None), (2, ""), (3, "   "), (4, long)])
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "call +1 234 567 890"), (1, "call +1 234 567 890"), (None, "a@b.c"), (None, None)]
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.spans) for r in got) == [(False, "phone:5:19"), (False, "phone:5:19"), (True, ""), (True, "email:0:5")]


def test_patterns_discover_unseen_identifiers(spark):
    rng = random.Random(1)
    number = lambda: f"{rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}"
    rows = [(i, f"words here and dial +1 {number()} now, then more words") for i in range(30)]
    rows += [(100, "please dial 415-555-2671 now"), (101, "there were 415-555-9999 words and more"), (102, "chapter 12 of 300")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:12:24" and got[101] == "" and got[102] == ""


def test_masking(spark):
    rows = [(1, "mail a@b.co, or +1 234 567 890!", "x"), (2, "clean", "y"), (3, None, "z"), (1, "other 10.0.0.1", "w")]
    got = sorted(tuple(r) for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string, spans string")).select("doc_id", "spans", "text").collect())
    assert got == [(1, "w", "other [IP]"), (1, "x", "mail [EMAIL], or [PHONE]!"), (2, "y", "clean"), (3, "z", None)]


def test_addresses_whose_first_part_is_zero(spark):
    check(spark, list(enumerate(["0.0.0.0", "0.1.2.3", "00.1.2.3", "at 000.0.00.255, then", "0256.1.1.1", "0.256.0.0", "0.0.0"])))


def test_patterns_discover_spaced_lettered_and_address_forms(spark):
    rng = random.Random(2)
    rows = [(i, f"words here and dial +1 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)} now, then pay 4111 1111 1111 1111 soon, or write u{i}@a.com quickly") for i in range(30)]
    rows += [(50 + i, f"again pay {c} soon") for i, c in enumerate(("5500 0000 0000 0004", "3400-000000-00009"))]
    want = {"please dial 415 555 2671 now": "phone:12:24", "please dial (415) 555-2671 now": "phone:12:26,phone:18:26", "then pay 4111 1111 1111 1112 soon": "card:9:28",
            "then pay DE89 3704 0044 0532 0130 00 soon": "card:9:36,card:14:36", "then pay AB1234567 soon": "card:9:18", "or write joe@localhost quickly": "email:9:22",
            "or write joe at example dot com quickly": "email:9:31", "there 415 555 9999 words": "", "there AB7654321 words": "", "meet at noon": ""}
    rows += [(100 + i, x) for i, x in enumerate(want)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i] for i in range(len(want))] == list(want.values())


def test_patterns_run_until_nothing_new(spark):
    # Each step's word is a pattern only when the identifiers that the last step's word brought are known.
    rows = [(i, f"w0 +1 234 567 80{i:02}") for i in range(30)]
    for step in range(6):
        for i in range(3):
            rows += [(0, f"w{step + k} 555-{step}{i}1-2671") for k in (0, 1, 1, 1, 1)]
    got = [r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(got)


def test_hidden_seeds_are_found_again(spark):
    """A quarter of the e-mail addresses and phones are hidden from the bootstrapping; their contexts are several words long."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "ka ti lo mu re".split() for b in "na so pi".split()]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    # Single words of the contexts are frequent elsewhere, so only their combinations tell.
    rows = [(i, f"{say(20)} ka na so user{i}x@mail{i % 7}.org {say(9)} lo mu pi +1 234 567 {1000 + i} {say(9)} so na ka {say(3)} pi mu lo {say(3)} ka so pi na mu") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, found = pii.scanned(docs, ["doc_id"])
    hide = pii.F.col("base") & (pii.F.pmod(pii.F.xxhash64("text"), pii.F.lit(4)) == 0)
    hidden = {(r.kind, r.text) for r in found.where(hide).collect()}
    got = {(r.kind, r.text) for r in pii.discovered(found.withColumn("base", pii.F.col("base") & ~hide), docs).collect()}
    assert len(hidden) > 40 and len(got & hidden) >= 0.95 * len(hidden)


@pytest.mark.parametrize(("sent", "endings"), [(0, 0), (0, 1000), (10**5, 0)])
def test_long_context_words_and_many_patterns(spark, monkeypatch, sent, endings):
    monkeypatch.setattr(pii, "SENT", sent)
    monkeypatch.setattr(pii, "ENDINGS", endings)
    long = "dial" + "x" * 200
    rows = [(i, f"words here {long} +1 {200 + i} 555 {1000 + i} now") for i in range(30)] + [(100, f"so {long} 415-555-2671"), (101, f"so q{long} 415-555-9999")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:208:220" and got[101] == ""
