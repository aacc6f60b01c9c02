"""Projects, sitemaps, encodings and archives."""

import struct

import pytest
from pyspark.sql import functions as F

from corvello.operators import catalog, links, trees
from corvello.sources import container, encoding, project

PROJECT = """[OPTIONS]
Author=Ann
 author = Bea
Error log file=log.txt
; nothing here
[WINDOWS]
side="Caption, with comma",,"idx.hhk","home.htm",,"j1.htm","Jump 1",,,0x1F,,0x4000,[1,-2,30],7
plain=Just text
[FILES]
pics\\One.gif
PICS/one.GIF
two.htm
[ALIAS]
first=deep\\page.htm ; why
#include names.ali
[MAP]
#define first 0xFF
#define second oops
"""


def test_project(spark, tmp_path):
    (tmp_path / "p.hhp").write_text("\ufeff" + PROJECT.replace("\n", "\r\n"))
    (tmp_path / "names.ali").write_text("; names\nsecond=far.htm\n#include names.ali\n")
    rows = project.project(spark, str(tmp_path / "p.hhp"))
    assert {(r.key, r.value) for r in project.options(rows).collect()} == {("author", "Bea"), ("error log file", "log.txt")}
    assert [r.path for r in project.files(rows).orderBy("ord").collect()] == ["pics/One.gif", "two.htm"]
    assert {(r.name, r.target) for r in project.aliases(rows).collect()} == {("first", "deep/page.htm"), ("second", "far.htm")}
    assert {(r.name, r.id) for r in project.maps(rows).collect()} == {("first", 255), ("second", 0)}
    side, plain = project.windows(rows).orderBy("ord").collect()
    assert (side.type, side.caption, side.toc, side["index"], side.default_file, side.home, side.jump1_file, side.jump1_text) == ("side", "Caption, with comma", "", "idx.hhk", "home.htm", "", "j1.htm", "Jump 1")
    assert (side.nav_style, side.nav_width, side.buttons, side.rect, side.styles, side.valid) == (31, 0, 16384, [1, -2, 30, 0], 7, 0x116)
    assert (plain.type, plain.caption, plain.rect, plain.valid) == ("plain", "Just text", [0, 0, 0, 0], 0)


SITEMAP = """<object type="text/site properties"><param name="Window Styles" value="0x25"><param name="Font" value="Sans,8"></object>
<ul><li><object type="text/sitemap"><param name="Name" value="A &amp; &#115;alt &#xE9; &nope; &#999;&amp;lt; & co"><param name="Local" value='a.htm'></object>
<li><object type="text/sitemap"><param name="Name" value="B"></object>
<ul><li><object type="text/sitemap"><param name="Name" value="B1"><param name="Local" value=b1.htm></object>
<li><object type="text/sitemap"><param name="Name" value="B2"><param name="Local" value="b2.htm"></object>
<ul><li><object type="text/sitemap"><param name="Name" value="B21"><param name="Local" value="b21.htm"></object></ul></ul></ul>"""


def test_sitemap_and_contents(spark):
    items, properties = project.sitemap(spark.createDataFrame([("c.hhc", SITEMAP)], "file string, html string"))
    assert [(r.name, r.value) for r in properties.orderBy("ord").collect()] == [("window styles", "0x25"), ("font", "Sans,8")]
    nodes = items.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), "ordinal", project.param("name").alias("name"), project.param("local").alias("local"))
    rows = {r.name: r for r in trees.contents(nodes).collect()}
    assert {n: (r.pos, r.props, r.seq, r.parent_ref, r.next_ref, r.first_child) for n, r in rows.items()} == {
        "A & salt é &nope; &lt; & co": (0, 8, 1, 0, 4116, 0), "B": (20, 4, 1, 0, 0, 4144), "B1": (48, 8, 2, 4116, 4164, 0), "B2": (68, 12, 3, 4116, 0, 4192), "B21": (96, 8, 4, 4164, 0, 0),
    }
    page = '<param name="keyword" value="out"><object type="y"><param name="other" value="z"><param name="ALink Name" value="a1"><param name="Keyword" value="k1"></object>'
    assert [(r.kind, r.value) for r in project.link_objects(spark.createDataFrame([("p", page)], "file string, html string")).orderBy("ord").collect()] == [("alink name", "a1"), ("keyword", "k1")]


def test_encodings(spark):
    cases = [(b"\xef\xbb\xbfa\xc3\xa9", "aé"), (b"\xff\xfea\x00", "a"), (b"\xfe\xff\x00a", "a"), (b"charset=utf-8 \xff\xc3\xa9", "charset=utf-8 ÿé"), (b"caf\xe9", "café"), ("café".encode(), "café"), (b"charset=windows-1251 \xe0", "charset=windows-1251 а"), (None, None)]
    got = spark.createDataFrame([(d, 1252) for d, _ in cases], "d binary, cp int").select(encoding.decoded("d", "cp")).collect()
    assert [r[0] for r in got] == [t for _, t in cases]
    got = spark.createDataFrame([("é€?Ж", 1252), ("Ж", 1251), ("日", 932)], "t string, cp int").select(encoding.encoded("t", "cp")).collect()
    assert [bytes(r[0]) for r in got] == [b"\xe9\x80??", b"\xc6", "日".encode()]
    lcids = spark.createDataFrame([(n,) for n in (0x409, 0x404, 0x804, 0x1004, 0x419, 0x81A, 0x41E, 0)], "n int").select(encoding.codepage_for_lcid(F.col("n"))).collect()
    assert [r[0] for r in lcids] == [1252, 950, 936, 936, 1251, 1250, 874, 1252]


class Writer:
    """Bits as 16-bit little-endian words."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value:0{n}b}" if n else ""

    def align(self):
        self.bits += "0" * (-len(self.bits) % 16)

    def data(self):
        self.align()
        return b"".join(int(self.bits[i : i + 16], 2).to_bytes(2, "little") for i in range(0, len(self.bits), 16))


def lengths(w, values):
    """Lengths by a code of twenty symbols of five bits each, as differences from 0."""
    for _ in range(20):
        w.put(5, 4)
    for v in values:
        w.put((17 - v) % 17, 5)


def verbatim(text, copies):
    """A block of literals, each followed by ``copies`` matches of three letters at distance one or at the last distance."""
    w = Writer()
    w.put(0, 1)
    w.put(1, 3)
    w.put(len(text) * (1 + 3 * copies), 24)
    main = [9] * 256 + [9] * 240  # 496 of 512 codes of nine bits
    lengths(w, main[:256])
    lengths(w, main[256:])
    lengths(w, [0] * 249)
    for c in text:
        w.put(c, 9)
        for _ in range(copies):
            w.put(256 + 1, 9)  # slot 0, the most recent distance (1), length 3
    return w.data()


def test_lzx_blocks():
    text = bytes(range(200)) * 3
    assert container.lzx_decode(verbatim(text, 0), len(text), 0x10000, 15) == text
    assert container.lzx_decode(verbatim(text, 2), len(text) * 7, 0x10000, 15) == b"".join(bytes([c]) * 7 for c in text)
    w = Writer()
    w.put(0, 1)
    w.put(3, 3)
    w.put(5, 24)
    raw = w.data() + struct.pack("<3i", 1, 1, 1) + b"hello"
    assert container.lzx_decode(raw, 5, 0x10000, 16) == b"hello"
    with pytest.raises(container.ArchiveError):
        container.lzx_decode(b"\xff" * 40, 100, 0x10000, 16)


def test_archives(spark, tmp_path):
    files = {"/b.htm": b"bee", "/A.htm": b"ay" * 5000, "/sub/c d.htm": b"", "::System": b"x", **{f"/f{k}.htm": bytes([k % 256]) * k for k in range(400)}}
    text = b"compressed page " * 10
    packed = {container.STORAGE + "Content": verbatim(text, 0), container.STORAGE + "ControlData": struct.pack("<I4s5I", 6, b"LZXC", 2, 2, 1, 1, 0), container.STORAGE + "SpanInfo": struct.pack("<Q", len(text))}
    (tmp_path / "a.arc").write_bytes(container.archive_bytes(files | packed))
    container.register(spark)
    got = spark.read.format("corvello_archive").option("content", "true").load(str(tmp_path / "*.arc"))
    assert {r.name: bytes(r.content) for r in got.collect()} == files | packed
    one = got.where("name = '/b.htm'").collect()
    assert [(r.name, bytes(r.content)) for r in one] == [("/b.htm", b"bee")]
    assert spark.read.format("corvello_archive").load(str(tmp_path / "a.arc")).where("content IS NOT NULL").count() == 0
    archive = container.Archive((tmp_path / "a.arc").read_bytes())
    assert archive.read(container.Entry("/z", 1, 11, 4)) == b"page"
    out = tmp_path / "out"
    told = container.extract(got.where("name <> '::System'"), str(out)).collect()
    assert all(r.ok for r in told) and (out / "A.htm").read_bytes() == files["/A.htm"] and (out / "sub/c d.htm").read_bytes() == b""
    bad = spark.createDataFrame([("/../../evil", b"x")], "name string, content binary")
    assert [r.ok for r in container.extract(bad, str(out)).collect()] == [False]
    for damaged in (b"", b"ITSF" + b"\0" * 100, (tmp_path / "a.arc").read_bytes()[:300]):
        with pytest.raises(container.ArchiveError):
            archive = container.Archive(damaged)
            archive.find("/b.htm")


def listed(data):
    """Names, sections, places and sizes by another reading of an archive: from one list chunk to the next, number by number."""
    out, at = {}, data.find(b"PMGL")
    while at >= 0:
        stream = iter(data[at + 20 : at + 4096 - int.from_bytes(data[at + 4 : at + 8], "little")])

        def number(first, stream=stream):
            value = first & 127
            while first > 127:
                first = next(stream)
                value = value * 128 + (first & 127)
            return value

        for first in stream:
            name = bytes(next(stream) for _ in range(number(first))).decode()
            out[name] = tuple(number(next(stream)) for _ in range(3))
        at = data.find(b"PMGL", at + 4096)
    return out


@pytest.mark.parametrize("compressed", [False, True])
def test_directory_by_another_reader(compressed):
    files = {f"/dir{k % 7}/Page{k}.htm": bytes([k % 251]) * (k * 37 % 900) for k in range(600)} | {"::Meta": b"m" * 300, "/é.htm": b"x"}
    data = container.archive_bytes(files, compressed=compressed)
    archive = container.Archive(data)
    assert listed(data) == {e.name: (e.section, e.offset, e.length) for e in archive.entries}
    assert {e.name: archive.read(e) for e in archive.entries if e.name in files} == files
    keys = [e.name.lower() for e in archive.entries]
    assert keys == sorted(keys)


def test_archives_by_sparks_reader(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(container.archive_bytes({"/x": b"1", "::y": b"22"}, compressed=True))
    got = container.read(spark, f"file://{tmp_path}/*.arc", content=True, names=["/x", "::y", "/none"]).collect()
    assert {(r.name, r.section, bytes(r.content)) for r in got} == {("/x", 1, b"1"), ("::y", 0, b"22")}


def test_catalog_and_closure(spark):
    pages = spark.createDataFrame([(0, "Start", "start.htm"), (10**12, "", "c.hhc"), (-5 + 10**13, "Again", "/START.htm")], "ord long, title string, url string")
    topics = catalog.topics(pages)
    assert [tuple(r) for r in topics.orderBy("topic_id").collect()] == [(0, "Start", "start.htm", 6), (1, None, "c.hhc", 2), (2, "Again", "/START.htm", 6)]
    wanted = spark.createDataFrame([(0, "x", "Start.htm"), (1, "New", "n.htm"), (2, "Other", "N.htm")], "ord long, name string, url string")
    found, every = catalog.looked_up_or_added(wanted, topics, 2)
    assert [(r.ord, r.topic_id) for r in found.orderBy("ord").collect()] == [(0, 0), (1, 3), (2, 3)]
    assert [tuple(r) for r in every.where("topic_id = 3").collect()] == [(3, "New", "n.htm", 2)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in links.closure(spark.createDataFrame([("a",)], "node string"), edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_stream_of_pages(spark, tmp_path):
    from corvello.streaming import incremental

    pages = spark.createDataFrame([(1, "<body>one two"), (2, "<body>two")], "doc long, html string")
    pages.write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.index_new_pages(spark, str(tmp_path / "in"), pages.schema, "doc", "html", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert run()
    spark.createDataFrame([(3, "<body>two more")], "doc long, html string").write.mode("append").parquet(str(tmp_path / "in"))
    assert run()
    got = incremental.read_postings(spark, str(tmp_path / "out")).groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in got} == {"one": 1, "two": 3, "more": 1}
