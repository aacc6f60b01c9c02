"""Hierarchies as adjacency rows (node, parent, ordinal): level order, paths, siblings and table-of-contents positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvello.operators.catalog import ordered_index
from corvello.storage import materialise

#: Nodes of one bucket of siblings or of a running sum.
BUCKET = 4096


def levels(nodes: DataFrame) -> DataFrame:
    """nodes (node, parent, ordinal, name, local) with depth, rank (the order key of its level) and path of names.

    One join for each depth, of nodes that are written once; a rank is the parent's rank and the ordinal, so no level is
    sorted as a whole.
    """
    nodes = materialise(nodes, "nodes")
    found = materialise(nodes.where("parent IS NULL").withColumn("depth", F.lit(0)).withColumn("rank", F.array("ordinal")).withColumn("path", F.col("name")), "levels")
    level = found
    while True:
        up = level.select(F.col("node").alias("parent"), F.col("depth").alias("d"), F.col("rank").alias("r"), F.col("path").alias("p"))
        down = nodes.join(up, "parent").select(*nodes.columns, (F.col("d") + 1).alias("depth"), F.concat("r", F.array("ordinal")).alias("rank"), F.concat_ws(", ", "p", "name").alias("path"))
        level = materialise(down, "levels")
        if not level.limit(1).count():
            return found
        found = found.union(level)


def chain_paths(nodes: DataFrame) -> DataFrame:
    """(node, depth, path) of nodes (node, parent, name) that hang together with a root; without a name on the way the path is null.

    A node's part of its path doubles each round, so a chain of n nodes takes log n rounds and not n.
    """
    parts = materialise(nodes.select("node", F.col("parent").alias("up"), F.lit(0).cast("long").alias("depth"), F.col("name").alias("path")), "chains")
    found = parts.where("up IS NULL")
    while parts.where("up IS NOT NULL").limit(1).count():
        above = parts.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("path").alias("p"))
        joined = parts.where("up IS NOT NULL").join(above, "up")
        longer = joined.select("node", F.col("next").alias("up"), (F.col("depth") + F.col("d") + 1).alias("depth"), F.concat("p", F.lit(", "), "path").alias("path"))
        # What has reached a root stays in parts: others' paths end with it.
        parts = materialise(parts.where("up IS NULL").union(longer), "chains")
        found = parts.where("up IS NULL")
    return found.drop("up")


def char_index(path: str, name: str):
    """Bytes of a path before its last name."""
    return (F.octet_length(path) - F.octet_length(name)).cast("long")


def siblings(nodes: DataFrame) -> DataFrame:
    """(node, parent, has_children, last, next_sibling).

    Children of one parent are taken in buckets of consecutive ordinals, so a parent of very many is many tasks' work; a
    bucket's last child is followed by the first one of the next bucket.
    """
    parents = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("has_children", F.lit(True))
    dealt = nodes.select("node", "parent", "ordinal", F.floor(F.col("ordinal") / BUCKET).alias("bucket"))
    firsts = dealt.groupBy("parent", "bucket").agg(F.min_by("node", "ordinal").alias("first"))
    firsts = firsts.select(F.col("parent").alias("p"), F.col("bucket").alias("b"), F.lead("first").over(Window.partitionBy("parent").orderBy("bucket")).alias("after"))
    near = F.lead("node").over(Window.partitionBy("parent", "bucket").orderBy("ordinal"))
    out = dealt.withColumn("near", near).join(firsts, F.col("parent").eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("b")))
    out = out.withColumn("next_sibling", F.coalesce("near", "after")).join(parents, "node", "left")
    return out.select("node", "parent", F.coalesce("has_children", F.lit(False)).alias("has_children"), F.col("next_sibling").isNull().alias("last"), "next_sibling")


def contents(nodes: DataFrame) -> DataFrame:
    """Table-of-contents rows in level order: pos (bytes before, 20 a node and 28 with children), props, seq (running
    count of nodes with a local target), next_ref and first_child (positions from 4096, 0 for none).

    Nodes are put in order by one range exchange; running sums go over each range, after the sums of the ranges before it,
    so no level and no parent's children meet in one task.
    """
    ranked = levels(nodes)
    flags = siblings(nodes).select("node", "has_children", "next_sibling")
    rows = ranked.join(flags, "node").withColumn("size", F.when(F.col("has_children"), 28).otherwise(20).cast("long")).withColumn("hit", (F.col("local") != "").cast("long"))
    rows = ordered_index(rows, ["depth", "rank"], "at").withColumn("bucket", F.floor(F.col("at") / BUCKET))
    sums = rows.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("hit").alias("hit"))  # a row for each BUCKET nodes
    order = Window.orderBy("bucket")
    sums = sums.select("bucket", (F.sum("size").over(order) - F.col("size")).alias("s"), (F.sum("hit").over(order) - F.col("hit")).alias("h"))
    within = Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("ws", F.sum("size").over(within) - F.col("size")).withColumn("wh", F.sum("hit").over(within)).join(sums, "bucket")
    placed = placed.select("node", "parent", "depth", "name", (F.col("s") + F.col("ws")).alias("pos"), (F.col("h") + F.col("wh")).alias("seq"), "has_children", "next_sibling", "size", "hit")
    first = placed.groupBy("parent").agg(F.min("pos").alias("child")).select(F.col("parent").alias("node"), "child")
    above = placed.select(F.col("node").alias("parent"), F.col("pos").alias("up"))
    out = placed.join(first, "node", "left").join(above, "parent", "left")
    return out.select(
        "node", "depth", "name", "pos", "seq", (F.when(F.col("has_children"), 4).otherwise(0) + F.col("hit") * 8).cast("long").alias("props"),
        F.coalesce(F.col("up") + 4096, F.lit(0)).cast("long").alias("parent_ref"),
        F.when(F.col("next_sibling").isNull(), 0).otherwise(4096 + F.col("pos") + F.col("size")).cast("long").alias("next_ref"),
        F.coalesce(F.col("child") + 4096, F.lit(0)).cast("long").alias("first_child"),
    )
