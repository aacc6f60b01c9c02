"""Archives as directory tables: order, offsets, listing, totals and collections of members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvello.functions.text import ascii_lower
from corvello.operators.catalog import ordered_index


def directory(files: DataFrame) -> DataFrame:
    """(name, section, offset, size) of files (ord, name, section, size): offsets run in order of ``ord`` in each section.

    Files are summed in buckets of consecutive ``ord``; one row for each bucket meets in one task.
    """
    dealt = files.withColumn("bucket", F.floor(F.col("ord") / 10_000))
    sums = dealt.groupBy("section", "bucket").agg(F.sum("size").alias("s"))
    sums = sums.select("section", "bucket", (F.sum("s").over(Window.partitionBy("section").orderBy("bucket")) - F.col("s")).alias("before"))
    within = F.sum("size").over(Window.partitionBy("section", "bucket").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return dealt.withColumn("inside", within).join(sums, ["section", "bucket"]).select("name", "section", (F.col("before") + F.col("inside")).cast("long").alias("offset"), "size")


def sorted_directory(entries: DataFrame) -> DataFrame:
    """Entries with rank, their place in an archive's directory: by ASCII-case-insensitive name."""
    return ordered_index(entries.withColumn("key", ascii_lower(F.col("name"))), ["key", "name"], "rank").drop("key")


def listing(entries: DataFrame) -> DataFrame:
    """(kind, size, name) of user-visible entries: names from the root that have content."""
    return entries.where(F.col("name").startswith("/") & (F.col("size") > 0)).select(F.when(F.col("section") != 0, "lzx").otherwise("raw").alias("kind"), "size", "name")


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.col("offset") + F.col("size")), F.lit(0)).alias("end"))


def collection(files: DataFrame) -> DataFrame:
    """A row for each member of files (member, size): files, bytes, ok (it has content) and its error else."""
    by_member = files.groupBy("member").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    ok = F.col("bytes") > 0
    return by_member.select("member", "files", "bytes", ok.alias("ok"), F.when(~ok, "nothing to build").alias("error"))


def collection_summary(members: DataFrame) -> DataFrame:
    return members.agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def chosen_sources(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """(member, source, path): for members wanted (member, flat, nested, prebuilt) the first of the three paths that exists."""
    there = listed.select(F.col("path").alias("p")).distinct()
    out = wanted
    for kind in ("flat", "nested", "prebuilt"):
        out = out.join(there.withColumn(f"has_{kind}", F.lit(True)).withColumnRenamed("p", kind), kind, "left")
    kinds = ("flat", "nested", "prebuilt")
    return out.select("member", F.coalesce(*(F.when(F.col(f"has_{k}"), k) for k in kinds)).alias("source"), F.coalesce(*(F.when(F.col(f"has_{k}"), F.col(k)) for k in kinds)).alias("path"))
