"""A small project from files to tables."""

import pytest

from corvello.plans import build
from tests_data import CONTENTS, INDEX, PAGES, PROJECT


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "help"
    (root / "port").mkdir(parents=True)
    for name, body in {"harbour.hhp": PROJECT, "guide.hhc": CONTENTS, "terms.hhk": INDEX, **PAGES}.items():
        (root / name).write_text(body)
    return root


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_build(spark, folder, tmp_path):
    out = build.build(spark, str(folder / "harbour.hhp"))
    assert [r.path for r in out["files"].orderBy("ord").collect()] == ["port/quay.htm", "guide.hhc", "terms.hhk", "tide.htm", "port/boats.htm", "map.png", "weather.htm"]
    assert rows(out["missing"], "path") == [("port/lost/chart.htm",)]
    assert rows(out["topics"], "topic_id", "title", "url", "in_contents") == [(0, "The quay", "port/quay.htm", 6), (1, "Tides", "tide.htm", 6), (2, "Boats &amp; crew", "port/boats.htm", 6), (3, None, "weather.htm", 2), (4, None, "guide.hhc", 2), (5, None, "terms.hhk", 2)]
    toc = {r.name: (r.pos, r.props, r.seq, r.topic_id, r.parent_ref, r.next_ref, r.first_child) for r in out["toc"].collect()}
    assert toc == {"Tides": (0, 8, 1, 1, 0, 4116, 0), "Port": (20, 4, 1, None, 0, 4144, 4164), "Weather": (48, 8, 2, 3, 0, 0, 0), "Quay": (68, 8, 3, 0, 4116, 4184, 0), "Boats": (88, 8, 4, 2, 4116, 0, 0)}
    assert rows(out["topic_toc"], "topic_id", "toc_pos") == [(0, 4164), (1, 4096), (2, 4184), (3, 4144)]
    assert rows(out["keywords"], "source_rank", "sort_key", "display", "topic_id") == [(0, "anchor", "anchor", 0), (0, "ferry", "Ferry", 2), (0, "ferry, tickets", "Ferry, tickets", 0), (1, "anchor", "Anchor", 2)]
    assert rows(out["alinks"], "display", "topic_id") == [("boat_kinds", 2)]
    assert rows(out["context_ids"], "id", "file") == [(42, "tide.htm")] and rows(out["context_unmatched"], "name", "id") == [("FERRY", 99)]
    assert rows(out["doc_freq"].where("word = 'tides'"), "ctx", "doc_freq", "total_freq") == [(0, 2, 3), (1, 1, 1)]
    assert out["fts_stats"].first().indexed_files == 4
    assert out["totals"].first().files == 7 and out["windows"].first().nav_width == 180
    assert {r.code: r.value for r in out["system"].collect()}[5] == "wide"
    build.save(out, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/topics")).count() == 6


def test_full_text_tables_need_a_word(spark, folder):
    (folder / "mute.hhp").write_text("[OPTIONS]\nFull-text search=Yes\n[FILES]\nmap.png\nblank.htm\n")
    (folder / "blank.htm").write_text("<body> . </body>")
    assert "postings" not in build.build(spark, str(folder / "mute.hhp"))


def test_collection_and_failures(spark, folder, tmp_path):
    (folder / "fleet.hhp").write_text("[OPTIONS]\nTitle=Fleet\n[MERGE FILES]\nharbour.chm\nnone.chm\nwreck.chm\nold\\ship.chm\n[FILES]\ntide.htm\n")
    (folder / "wreck.hhp").write_text("[FILES]\nnot-there.htm\n")
    (folder / "ship.chm").write_text("built before")
    got = {r.member: (r.ok, r.source, r.error) for r in build.collection(spark, str(folder / "fleet.hhp"), str(tmp_path / "out")).collect()}
    assert got == {
        "harbour": (True, "flat", None), "none": (False, None, "no none.hhp and no prebuilt none.chm"), "wreck": (False, "flat", "not-there.htm cannot be read"),
        "ship": (True, "prebuilt", None), "fleet.hhp": (True, "master", None),
    }


def test_output_path():
    assert build.output_path("/a/b.hhp", {}, "/x/y.chm") == "/x/y.chm"
    assert build.output_path("/a/b.hhp", {"compiled file": "out\\c.chm"}) == "/a/out/c.chm"
    assert build.output_path("/a/b.c.hhp", {}) == "/a/b.c.chm"
