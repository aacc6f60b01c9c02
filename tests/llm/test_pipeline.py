"""The pipeline's stages and their effects, and that the library does not need them."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from corvello.llm import neardup

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(100_001, None, "en", "s", 0), (100_002, "%% 12", None, None, None), (100_003, "mail a@b.co or +1 234 567 890 12 now", "en", "s", 5), (100_004, "mail a@b.co or +1 234 567 890 12 now", "en", "s", 5)], docs.schema)
    docs, kept = docs.union(extra), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert 100_001 not in kept["language_id"] and 100_002 not in kept["language_id"] and 100_003 in kept["language_id"]
    assert 100_003 in kept["near_dedup"] and 100_004 not in kept["near_dedup"]
    assert len(kept["decontamination"]) < len(kept["near_dedup"])
    assert kept["pii"].keys() == kept["decontamination"].keys()
    assert kept["pii"][100_003].text == "mail [EMAIL] or [PHONE] now" and kept["pii"][100_003].n_chars == 27
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["pii"])
    groups = {r.doc_id: r for r in neardup.groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(groups[i].kept for i in kept["near_dedup"] if i in groups)


def test_stages_on_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string, n_hit int, longest_start int, row int, node int, base int, spans int, kept int, component_id int, length int, piece int, __row int, __0 int"
    columns = [c.split()[0] for c in schema.split(", ")]
    more = ("p", "q", *range(1, 13))
    texts = [None, "", "some words that are here", "mail a@b.co or call +1 234 567 890 12 now", "mail a@b.co or call +1 234 567 890 12 now", "word " * 40_000]
    rows = [(k if k else None, t, "en", "s", 1, *more) for k, t in enumerate(texts)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
            assert docs.columns == columns, name
            assert all(tuple(r)[5:] == more for r in docs.collect()), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == (0 if not given else sum(-(-n // 2048) for n in _lengths(docs)))
    assert sorted(r.text[:30] for r in docs.collect()) == ["mail [EMAIL] or call [PHONE] n", "some words that are here", ("word " * 6)]


def _lengths(docs):
    from tokenizers import Tokenizer

    from corvello.llm import queries

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()]


def test_library_stands_without_the_subpackage(tmp_path):
    for name in ("corvello", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name)
    (tmp_path / "corvello").unlink()
    (tmp_path / "corvello").mkdir()
    for part in (ROOT / "corvello").iterdir():
        if part.name != "llm":
            (tmp_path / "corvello" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fts_words' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_near_duplicates_go_by_row(spark):
    a, b, c = ("".join(f"{w}{k} " for k in range(40)) for w in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (None, c), (None, "x y z"), (None, "x y z"), (5, "short"), (5, "other")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted([(1, a), (2, b), (4, c), (None, "x y z"), (5, "short"), (5, "other")], key=key)
