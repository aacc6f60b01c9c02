"""Topic catalog, dictionaries, lookups and keyword index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvello.functions.text import ascii_lower
from corvello.storage import materialise

def ordered_index(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with ``name``, 0 and up in the order of any columns, by one range exchange.

    The ranges are written once, with each row's place in its range; counts of ranges are all that meets in one task.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(sorted_rows.withColumn("__part", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(before, "__part").withColumn(name, (F.col("__before") + F.col("__k")).cast("long")).drop("__part", "__k", "__before")


def in_contents(url: Column, title: Column, code: Column | None = None) -> Column:
    """A topic's flag: the caller's code, or 0 for a place in a page, 2 without title, else 6."""
    own = F.when(url.contains("#"), 0).when(F.coalesce(title, F.lit("")) == "", 2).otherwise(6)
    return own if code is None else F.when(code >= 0, code).otherwise(own)


def topics(pages: DataFrame) -> DataFrame:
    """(topic_id, title, url, in_contents) of pages (ord, title, url), numbered in order; an empty title is null."""
    return ordered_index(pages, ["ord"], "topic_id").select("topic_id", F.nullif("title", F.lit("")).alias("title"), "url", in_contents(F.col("url"), F.col("title")).alias("in_contents"))


def url_key(url: Column) -> Column:
    return ascii_lower(F.regexp_replace(url, "^/", ""))


def first_topics(found: DataFrame) -> DataFrame:
    """(url_key, topic_id): the first topic of each URL."""
    return found.groupBy(url_key(F.col("url")).alias("url_key")).agg(F.min("topic_id").alias("topic_id"))


def looked_up_or_added(wanted: DataFrame, found: DataFrame, code: int) -> tuple[DataFrame, DataFrame]:
    """wanted (ord, name, url) with topic_id, and topics with those appended that no URL had, in order of ``ord``."""
    known = first_topics(found)
    asked = wanted.withColumn("url_key", url_key(F.col("url")))
    new = asked.join(known, "url_key", "left_anti").groupBy("url_key").agg(F.min_by(F.struct("ord", "name", "url"), "ord").alias("f")).select("f.*")
    after = found.agg(F.coalesce(F.max("topic_id") + 1, F.lit(0)).alias("next"))
    new = ordered_index(new, ["ord"], "k").crossJoin(F.broadcast(after)).select((F.col("next") + F.col("k")).alias("topic_id"), F.nullif("name", F.lit("")).alias("title"), "url", in_contents(F.col("url"), F.col("name"), F.lit(code)).alias("in_contents"))
    every = found.unionByName(new)
    return asked.join(first_topics(every), "url_key", "left").drop("url_key"), every


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """(id, value): distinct values in byte order; 0 is the empty text."""
    distinct = values.select(F.coalesce(F.col(column), F.lit("")).alias("value")).union(values.sparkSession.createDataFrame([("",)], "value string")).distinct()
    return ordered_index(distinct, ["value"], "id").select("id", "value")


def keyword_index(entries: DataFrame) -> DataFrame:
    """(source_rank, sort_key, display, topic_id, ord) of entries (source_rank, ord, keyword, topic_id).

    Keywords are one for each source, case-insensitively, and sources stay apart; the first spelling is shown.  A topic
    is listed once, at its first place.  Rows are one for each keyword and topic, so no keyword is gathered into a row.
    """
    keyed = entries.withColumn("sort_key", ascii_lower(F.col("keyword")))
    first = keyed.groupBy("source_rank", "sort_key", "topic_id").agg(F.min("ord").alias("ord"), F.min_by("keyword", "ord").alias("keyword"))
    shown = first.groupBy("source_rank", "sort_key").agg(F.min_by("keyword", "ord").alias("display"))
    return first.drop("keyword").join(shown, ["source_rank", "sort_key"]).select("source_rank", "sort_key", "display", "topic_id", "ord")


def keyword_order(index: DataFrame) -> DataFrame:
    """(seq, sort_key, source_rank, data): keywords of keyword_index() in byte order, of equal ones the list's before the pages'
    and then as they come; data is the place of a keyword's data, which are 13 bytes apart."""
    first = index.groupBy("sort_key", "source_rank").agg(F.min("ord").alias("ord"))
    placed = ordered_index(first, ["sort_key", "source_rank", "ord"], "seq")
    return placed.select("seq", "sort_key", "source_rank", (F.col("seq") * 13).alias("data"))


def context_ids(defined: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, file) of defined (ord, name, id) by aliases (ord, name, file): first alias of a name, last definition of an id."""
    first = aliases.groupBy("name").agg(F.min_by("file", "ord").alias("file"))
    return defined.join(first, "name").groupBy("id").agg(F.max_by("file", "ord").alias("file"))


def context_unmatched(defined: DataFrame, aliases: DataFrame) -> DataFrame:
    return defined.join(aliases, "name", "left_anti").select("name", "id")
