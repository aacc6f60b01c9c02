"""The positional inverted index of pages: runs of text, words, postings, statistics and posting sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvello.functions.text import LEXER, WORD, ascii_lower, code_bits, entity
from corvello.storage import materialise

#: Words longer than this are not indexed, though they take a position.
LONGEST = 99
#: Documents of one range of a word's postings, so that a frequent word's gaps are many tasks' work.
RANGE = 4096


def runs(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, run, ctx, text) of stretches of visible text between tags; ctx 1 is the title, 0 the body.

    Pages are dealt by document before they are cut into tokens, so windows and sums need no further exchange.
    Comments do not end a run; an unterminated tag ends the page.
    """
    dealt = pages.select(F.col(doc).alias("doc"), F.col(html).alias("html")).repartition("doc")
    tokens = dealt.select("doc", F.posexplode(F.regexp_extract_all("html", F.lit(LEXER), F.lit(0))).alias("i", "token"))
    token = F.col("token")
    is_tag = token.startswith("<") & ~token.startswith("<!--")
    tokens = tokens.where(~token.startswith("<!--")).withColumn("tag", F.when(is_tag, ascii_lower(F.substring(token, 2, 8))))
    upto = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)

    def event(name: str) -> Column:
        return F.when(F.col("tag").startswith(name), True).when(F.col("tag").startswith("/" + name), False)

    def last(c: Column, over: Window = upto) -> Column:
        return F.coalesce(F.last(c, ignorenulls=True).over(over), F.lit(False))

    state = tokens.select("*", last(event("body")).alias("body"), last(event("body"), before).alias("was"), F.count("tag").over(upto).alias("run"))
    state = state.select("*", last(F.when(~F.col("was"), event("title"))).alias("title"), *(last(F.when(F.col("was"), event(n))).alias(n) for n in ("script", "style")))
    in_title = F.col("title") & ~F.col("body")
    seen = state.where("tag IS NULL").where(in_title | (F.col("body") & ~F.col("script") & ~F.col("style")))
    text = F.when(token.rlike("^&[^;]*;$"), entity(F.substring(token, 2, F.length(token) - 2))).otherwise(token)
    seen = seen.select("doc", "run", in_title.cast("int").alias("ctx"), F.struct("i", text.alias("text")).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), "")
    return seen.groupBy("doc", "run").agg(F.max("ctx").alias("ctx"), joined.alias("text"))


def words(text_runs: DataFrame) -> DataFrame:
    """(doc, word, ctx, pos): positions count through a document's runs, also over words that are too long to keep."""
    found = text_runs.select("doc", "run", "ctx", F.posexplode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))).alias("k", "word"))
    pos = F.row_number().over(Window.partitionBy("doc").orderBy("run", "k")) - 1
    found = found.select("doc", F.replace("word", F.lit("'"), F.lit("")).alias("word"), "ctx", pos.cast("long").alias("pos"))
    return found.where(F.length("word") <= LONGEST)


def plain_words(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Words of plain texts, each one run of body text."""
    return words(docs.select(F.col(doc).alias("doc"), F.lit(1).alias("run"), F.lit(0).alias("ctx"), F.col(text).alias("text")).where("text IS NOT NULL").repartition("doc"))


def postings(found: DataFrame) -> DataFrame:
    """(word, ctx, doc, tf, positions in order): partial sums before the shuffle keep frequent words small."""
    return found.groupBy("word", "ctx", "doc").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def doc_freq(found: DataFrame) -> DataFrame:
    per_doc = found.groupBy("word", "ctx", "doc").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("word", "ctx").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_freq"))


def statistics(text_runs: DataFrame) -> DataFrame:
    """One row: indexed files, words, their bytes, the longest, distinct (word, ctx) and their bytes."""
    files = text_runs.where(F.length("text") > 0).agg(F.countDistinct("doc").alias("indexed_files"))
    by_word = words(text_runs).groupBy("word", "ctx").agg(F.count(F.lit(1)).alias("n"))
    size = F.octet_length("word").cast("long")
    totals = by_word.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.coalesce(F.sum(F.col("n") * size), F.lit(0)).alias("total_word_bytes"),
        F.coalesce(F.max(size), F.lit(0)).alias("longest_word"), F.count(F.lit(1)).alias("distinct_words"), F.coalesce(F.sum(size), F.lit(0)).alias("distinct_word_bytes"),
    )
    return files.join(F.broadcast(totals))  # one row each


def gaps(found: DataFrame) -> DataFrame:
    """(word, ctx, doc, pos, doc_gap, pos_gap): differences from the posting before; a first one is its own value.

    doc_gap is a difference within a range of documents, or from the last document of the range before.  Words are written
    once, for they are read three times.
    """
    found = materialise(found, "words")
    per_doc = found.groupBy("word", "ctx", "doc").agg(F.count(F.lit(1)).alias("tf")).withColumn("range", F.floor(F.col("doc") / RANGE))
    ends = per_doc.groupBy("word", "ctx", "range").agg(F.max("doc").alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(Window.partitionBy("word", "ctx").orderBy("range"))).drop("end")
    near = F.lag("doc").over(Window.partitionBy("word", "ctx", "range").orderBy("doc"))
    docs = per_doc.withColumn("near", near).join(ends, ["word", "ctx", "range"]).select("word", "ctx", "doc", (F.col("doc") - F.coalesce("near", "before", F.lit(0))).alias("doc_gap"))
    pos_gap = F.col("pos") - F.coalesce(F.lag("pos").over(Window.partitionBy("word", "ctx", "doc").orderBy("pos")), F.lit(0))
    return found.withColumn("pos_gap", pos_gap).join(docs, ["word", "ctx", "doc"])


def sizes(found: DataFrame) -> DataFrame:
    """(word, ctx, doc, bits, bytes): a posting list's coded size, aligned to bytes for each document."""
    each = gaps(found).groupBy("word", "ctx", "doc", "doc_gap").agg(F.count(F.lit(1)).alias("tf"), F.sum(code_bits(F.col("pos_gap"), 5)).alias("pos_bits"))
    bits = code_bits(F.col("doc_gap"), 2) + code_bits(F.col("tf"), 1) + F.col("pos_bits")
    return each.select("word", "ctx", "doc", bits.alias("bits"), F.ceil(bits / 8).cast("long").alias("bytes"))
