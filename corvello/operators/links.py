"""References of pages, what they mean, and what can be reached by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvello.functions.text import ascii_lower, dir_of, references, resolve
from corvello.storage import discard, materialise


def refs(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, kind, ordinal, ref): all values of href, then all of src, in order."""
    each = [pages.select(F.col(doc).alias("doc"), F.lit(kind).alias("kind"), F.posexplode(references(F.col(html), kind)).alias("ordinal", "ref")) for kind in ("href", "src")]
    return each[0].union(each[1]).withColumn("ordinal", F.col("ordinal").cast("long"))


def resolved(found: DataFrame, paths: DataFrame) -> DataFrame:
    """refs with target, the path a reference means; paths: doc, path of each page."""
    return found.join(paths, "doc").withColumn("target", resolve(dir_of(F.col("path")), F.col("ref"))).drop("path")


def dangling(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """(target, n) of local targets that no page has as its path, case-insensitively."""
    there = paths.select(ascii_lower(F.col("path")).alias("key")).distinct()
    wanted = targets.where("target <> ''").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return wanted.withColumn("key", ascii_lower(F.col("target"))).join(there, "key", "left_anti").drop("key")


def closure(seeds: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, hop): everything reachable from seeds (node) along edges (src, dst), with the least number of hops.

    Only nodes found in the last round are followed; edges and each round are written tables, so nothing is made twice.
    """
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    seen = materialise(seeds.select("node").distinct().withColumn("hop", F.lit(0).cast("long")), "closure")
    frontier, hop = seen, 0
    while hops is None or hop < hops:
        hop += 1
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialise(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop).cast("long")), "closure")
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    discard(edges)
    return seen
