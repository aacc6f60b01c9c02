"""Adversarial pages, references and scalar functions against hand-derived results and a small state machine."""

import random
import re

from pyspark.sql import functions as F

from corvello.functions import text
from corvello.operators import fulltext


def page_words(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "doc long, html string")
    found = fulltext.words(fulltext.runs(df, "doc", "html")).collect()
    return [sorted((r.pos, r.word, r.ctx) for r in found if r.doc == k) for k in range(len(pages))]


def model(html):
    """A character-by-character reading of a page: (word, ctx, pos)."""
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    title = body = script = style = False
    i, runs, current, ctx = 0, [], "", 0
    while i < len(html):
        if html[i] == "<":
            if html.startswith("<!--", i):
                end = html.find("-->", i + 2)
                i = len(html) if end < 0 else end + 3
                continue
            end = html.find(">", i)
            if end < 0:
                break
            if current:
                runs.append((ctx, current))
                current = ""
            tag = low(html[i + 1 : end])
            if body:
                body = body and not tag.startswith("/body")
                if not tag.startswith("/body"):
                    script = tag.startswith("script") or (script and not tag.startswith("/script"))
                    style = tag.startswith("style") or (style and not tag.startswith("/style"))
            elif tag.startswith("title") or tag.startswith("/title"):
                title = tag[0] != "/"
            elif tag.startswith("body"):
                body = True
            i = end + 1
            continue
        piece, step = html[i], 1
        if html[i] == "&" and 0 <= (semi := html.find(";", i)) - i <= 10:
            name, step = html[i + 1 : semi], semi - i + 1
            piece = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}.get(name, " ")
            if m := re.fullmatch(r"#(?:[xX]([0-9a-fA-F]+)|([0-9]+))", name):
                code = int(m[1], 16) if m[1] else int(m[2])
                piece = chr(code) if 0 < code < 256 else " "
        if (title and not body) or (body and not script and not style):
            ctx, current = int(title and not body), current + piece
        i += step
    if current:
        runs.append((ctx, current))
    out, pos = [], 0
    for ctx, run in runs:
        for w in re.findall("[0-9][0-9a-z.']*|[a-z][0-9a-z']*", low(run)):
            w = w.replace("'", "")
            if len(w) <= 99:
                out.append((pos, w, ctx))
            pos += 1
    return out


def test_adversarial_pages(spark):
    pages = [
        "<body>foo<!-- x -->bar", "<body>a<!-->b", "<body>x <unterminated", "<body>z & w &<b>; q", "<body>don't 3.14. k&#65;z a&nbsp;b",
        f"<body>{'l' * 120} next", "<body>\u212a", "<body>late</body><title>t</title>", "<title>Café Menü</title><body>café menü",
    ]
    got = page_words(spark, pages)
    assert [w for _, w, _ in got[0]] == ["foobar"] and [w for _, w, _ in got[1]] == ["ab"] and [w for _, w, _ in got[2]] == ["x"]
    assert [w for _, w, _ in got[3]] == ["z", "q"] and [w for _, w, _ in got[4]] == ["dont", "3.14.", "kaz", "a", "b"]
    assert got[5] == [(1, "next", 0)] and got[6] == [] and got[7] == [(0, "late", 0), (1, "t", 1)]
    assert got[8] == [(0, "caf", 1), (1, "men", 1), (2, "caf", 0), (3, "men", 0)]


def test_random_pages_equal_the_state_machine(spark):
    rng = random.Random(5)
    parts = ["<body>", "</body>", "<title>", "</title>", "<script>", "</script>", "<STYLE x>", "</style>", "<!-- c -->", "<!-->", "<b>", "&amp;", "&#66;", "&#x41;", "&zz;", "& ", "word ", "It's", "3.5.", "é", "\n", "<", "x"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for page, got in zip(pages, page_words(spark, pages), strict=True):
        assert got == model(page), page


def test_fixture_pages_equal_the_state_machine(spark):
    import pyarrow.parquet as pq

    pages = [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()]
    for page, got in zip(pages, page_words(spark, pages), strict=True):
        assert got == model(page)


def test_references(spark):
    cases = [("d/p.htm", "#a", ""), ("d/p.htm", "http://h/x", ""), ("d/p.htm", "C:\\x", ""), ("d/p.htm", "../../x", ""), ("d/p.htm", "//host/x", "host/x"), ("d/p.htm", "b%20c.htm?q#f", "d/b c.htm"), ("p.htm", "/a/./b/../c", "a/c"), ("p.htm", " a+b%ZZ% ", "a+b%ZZ%"), ("p.htm", "", ""), ("x/p.htm", "?q", "")]
    df = spark.createDataFrame(cases, "page string, ref string, want string")
    got = df.select("ref", "want", text.resolve(text.dir_of(F.col("page")), F.col("ref")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got
    html = """<a href="one">x</a> <A HREF = 'two'> <img src=three> data-href="no" <!-- href=four> --> <a href="href='five'">"""
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(text.references(F.col("html"), "href")).first()[0] == ["one", "two", "four", "href='five'", "five"]
    assert df.select(text.references(F.col("html"), "src")).first()[0] == ["three"]


def test_scalars(spark):
    row = spark.sql("SELECT 1").select(
        text.parse_int(F.lit(" 0x51A7 ")), text.parse_int(F.lit("12")), text.parse_int(F.lit("x")), text.parse_lcid(F.lit("0x409 English")), text.parse_lcid(F.lit("")),
        text.is_yes(F.lit(" Yes")), text.is_yes(F.lit("no")), text.stem(F.lit("a\\b/c.d.hhp")), text.trimmed(F.lit("\u00a0 x \u00a0")),
        *(text.code_bits(F.lit(v), r) for v, r in ((0, 2), (3, 2), (4, 2), (1, 1), (31, 5), (32, 5))),
        text.title(F.lit("<TITLE a>\n A  &amp;\tB </TITLE>")), text.title(F.lit("<title>x")), text.charset(F.lit('<meta charset="UTF-8">')),
    ).first()
    assert list(row) == [0x51A7, 12, 0, 0x409, 1033, True, False, "c.d", "x", 3, 3, 4, 2, 6, 7, "A &amp; B", "", "utf-8"]
