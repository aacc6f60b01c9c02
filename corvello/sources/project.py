"""Project files, table-of-contents and index files as relations, in DataFrame expressions.

Lines are rows (file, ord, line).  Included files are read by a loop over file names that remembers what it has read,
so files that include each other end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvello.functions.text import ascii_lower, parse_int, slashes, trimmed

# Fixed layout of a window definition: text fields, number fields with the bit that marks them given, and the bit of the rectangle.
WINDOW_TEXTS = ("type", "caption", "toc", "index", "default_file", "home", "jump1_file", "jump1_text", "jump2_file", "jump2_text")
WINDOW_PATHS = ("toc", "index", "default_file", "home", "jump1_file", "jump2_file")
WINDOW_NUMBERS = (("nav_style", 0x2), ("nav_width", 0x20), ("buttons", 0x100))
WINDOW_LATER = (("styles", 0x4), ("ex_styles", 0x8), ("show_state", 0x40), ("nav_closed", 0x200), ("nav_default", 0x2000), ("nav_pos", 0x400), ("notify_id", 0))
WINDOW_RECT = 0x10
# Fixed entity names of sitemap values; unknown ones stay as they are.
SITEMAP_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

TAG = r"<[^>]*>"
ATTRIBUTE = r"([^\s=>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, ord, line) of text files, without a byte order mark; files are rows, lines are cut inside them."""
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return text.select("file", F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("ord", "line"))


def sections(rows: DataFrame) -> DataFrame:
    """(file, ord, section, line): trimmed lines under the lower-case name of their section; no blank lines and comments."""
    told = rows.withColumn("line", trimmed(F.col("line"))).where((F.col("line") != "") & ~F.col("line").startswith(";"))
    head = F.when(F.col("line").rlike(r"^\[.*\]$"), ascii_lower(F.expr("substring(line, 2, length(line) - 2)")))
    over = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = told.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(over))
    return out.where(F.col("head").isNull() & F.col("section").isNotNull()).select("file", "ord", "section", "line")


def options(rows: DataFrame) -> DataFrame:
    """(file, key, value): keys in lower case, the last one wins."""
    pairs = rows.where((F.col("section") == "options") & F.contains("line", F.lit("="))).select("file", "ord", ascii_lower(trimmed(F.regexp_extract("line", "^([^=]*)=", 1))).alias("key"), trimmed(F.regexp_extract("line", "^[^=]*=(.*)$", 1)).alias("value"))
    return pairs.groupBy("file", "key").agg(F.max_by("value", "ord").alias("value"))


def files(rows: DataFrame, section: str = "files") -> DataFrame:
    """(file, ord, path): each path once, case-insensitively, in its first spelling."""
    paths = rows.where(F.col("section") == section).select("file", "ord", slashes(F.col("line")).alias("path"))
    first = paths.groupBy("file", ascii_lower(F.col("path")).alias("key")).agg(F.min(F.struct("ord", "path")).alias("f"))
    return first.select("file", "f.ord", "f.path")


def aliases(rows: DataFrame) -> DataFrame:
    """(file, ord, name, target): name=file, what follows a semicolon is a comment."""
    told = rows.where((F.col("section") == "alias") & ~F.col("line").startswith("#") & F.contains("line", F.lit("=")))
    return told.select("file", "ord", trimmed(F.regexp_extract("line", "^([^=]*)=", 1)).alias("name"), slashes(trimmed(F.regexp_extract("line", "^[^=]*=([^;]*)", 1))).alias("target"))


def maps(rows: DataFrame) -> DataFrame:
    """(file, ord, name, id): #define name number; numbers that cannot be read are 0."""
    pattern = r"^#define\s+(\S+)[ \t]+(.*)$"
    return rows.where((F.col("section") == "map") & F.col("line").rlike(pattern)).select("file", "ord", F.regexp_extract("line", pattern, 1).alias("name"), parse_int(F.regexp_extract("line", pattern, 2)).alias("id"))


def includes(rows: DataFrame) -> DataFrame:
    """(file, ord, section, path) of include lines of the alias and map sections."""
    found = rows.where(F.col("section").isin("alias", "map") & F.col("line").rlike("^#") & ~F.col("line").startswith("#define"))
    path = F.regexp_extract("line", r"^#\S*\s+[\"<]?([^\">]*)", 1)
    return found.select("file", "ord", "section", slashes(trimmed(path)).alias("path")).where("path <> ''")


def project(spark: SparkSession, path: str) -> DataFrame:
    """sections() of a project file with its included files' lines, each file read once; those that are missing are left out."""
    told = sections(lines(spark, path))
    folder, seen, out = path.rpartition("/")[0], {path}, told
    todo = [(r.section, r.path) for r in includes(told).collect()]
    while todo:
        section, name = todo.pop()
        full = f"{folder}/{name}"
        where = spark._jvm.org.apache.hadoop.fs.Path(full)
        if full in seen or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            continue
        seen.add(full)
        more = lines(spark, full).withColumn("line", trimmed(F.col("line"))).where((F.col("line") != "") & ~F.col("line").startswith(";")).select("file", "ord", F.lit(section).alias("section"), "line")
        todo += [(r.section, r.path) for r in includes(more).collect()]
        out = out.union(more)
    return out


def windows(rows: DataFrame) -> DataFrame:
    """(file, ord, a column for each field, rect, valid): fields that are not given are empty or 0 and have no bit in valid."""
    line = F.regexp_replace("line", "^([^=]*)=", "$1,")
    # Quoted fields go to the closing quote and on to the next comma; bare ones are trimmed.
    fields = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r"(?:\"([^\"]*)\"[^,]*|([^,\"][^,]*|)),"), F.lit(0))
    clean = F.transform(fields, lambda f: F.when(f.startswith('"'), F.regexp_extract(f, '^"([^"]*)"', 1)).otherwise(trimmed(F.regexp_extract(f, "^([^,]*),$", 1))))
    told = rows.where(F.col("section") == "windows").select("file", "ord", clean.alias("f"))
    at = lambda i: F.coalesce(F.get("f", i if isinstance(i, Column) else F.lit(i)), F.lit(""))
    first = len(WINDOW_TEXTS) + len(WINDOW_NUMBERS)
    bracket = F.slice("f", first + 1, 4)
    # The rectangle takes fields up to the one with the closing bracket, four at most.
    n = F.when(at(first).startswith("["), F.least(F.lit(4), F.greatest(F.array_position(F.transform(bracket, lambda f: f.contains("]")), True).cast("int"), F.lit(0)))).otherwise(1)
    told = told.withColumn("n", F.when(n == 0, 4).otherwise(n)).withColumn("has_rect", at(first).startswith("["))
    side = lambda k: F.when(F.col("has_rect") & (F.col("n") > k), F.coalesce(trimmed(F.regexp_extract(at(first + k), r"\[?([^\]]*)", 1)).try_cast("int"), F.lit(0))).otherwise(0)
    any_side = F.col("has_rect") & F.exists(F.slice("f", F.lit(first + 1), F.col("n")), lambda f: trimmed(F.regexp_extract(f, r"\[?([^\]]*)", 1)) != "")
    numbers = [(name, bit, at(len(WINDOW_TEXTS) + k)) for k, (name, bit) in enumerate(WINDOW_NUMBERS)] + [(name, bit, at(F.col("n") + first + k)) for k, (name, bit) in enumerate(WINDOW_LATER)]
    valid = sum((F.when(value != "", bit).otherwise(0) for _, bit, value in numbers), F.when(any_side, WINDOW_RECT).otherwise(0))
    texts = [(slashes(at(k)) if name in WINDOW_PATHS else at(k)).alias(name) for k, name in enumerate(WINDOW_TEXTS)]
    return told.select("file", "ord", *texts, *(parse_int(value).alias(name) for name, _, value in numbers), F.array(*map(side, range(4))).alias("rect"), valid.cast("long").alias("valid"))


def attributes(tag: Column) -> Column:
    """(name in lower case, value) of a tag's attributes, with the entities of values decoded."""
    parts = [F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(g)) for g in range(1, 5)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "nabc", strict=True)))
    return F.transform(zipped, lambda x: F.struct(ascii_lower(x["n"]).alias("name"), decoded(F.concat(x["a"], x["b"], x["c"])).alias("value")))


def decoded(value: Column) -> Column:
    """Entities of sitemap values, one by one from left to right.

    Unknown names stay as they are; numbers are characters of Latin-1, others and what is no number after # are dropped.
    """
    known = F.create_map(*(F.lit(x) for kv in SITEMAP_ENTITIES.items() for x in kv))

    def text(token: Column) -> Column:
        name = F.substring(token, 2, F.length(token) - 2)
        number = F.when(name.rlike(r"^#[xX]\+?[0-9A-Fa-f]+$"), F.conv(F.regexp_extract(name, "([0-9A-Fa-f]+)$", 1), 16, 10)).when(name.rlike(r"^#\+?[0-9]+$"), F.regexp_extract(name, "([0-9]+)$", 1)).cast("long")
        coded = F.when(number.between(1, 255), F.char(number)).otherwise(F.lit(""))
        return F.when(~token.rlike("^&[^;]*;$"), token).when(name.startswith("#"), coded).otherwise(F.coalesce(F.try_element_at(known, name), token))

    tokens = F.regexp_extract_all(value, F.lit("&[^;]{0,9};|[^&]+|&"), F.lit(0))
    return F.when(value.contains("&"), F.array_join(F.transform(tokens, text), "")).otherwise(value)


def attribute(attrs: Column, name: str) -> Column:
    return F.coalesce(F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"], F.lit(""))


def sitemap(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (file, node, parent, ordinal, depth, params) and properties (file, ord, name, value) of sitemaps (file, html).

    node is the place of an item's object among the file's tags.  A list belongs to the last item before it on the level
    above; several lists of one item are one.  Depth is a running sum, and the parent the last item one level higher.
    """
    tags = pages.repartition("file").select("file", F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("i", "tag"))
    tags = tags.withColumn("name", ascii_lower(F.regexp_extract("tag", r"^<\s*(/?[A-Za-z0-9]+)", 1))).where(F.col("name").isin("ul", "/ul", "object", "/object", "param"))
    tags = tags.withColumn("attrs", attributes(F.regexp_replace("tag", r"^<\s*/?[A-Za-z0-9]+|>$", "")))
    over = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    kind = ascii_lower(attribute(F.col("attrs"), "type"))
    opened = F.when(F.col("name") == "object", F.struct(F.col("i").alias("node"), kind.alias("kind"))).when(F.col("name") == "/object", F.struct(F.lit(-1).alias("node"), F.lit("").alias("kind")))
    depth = F.sum(F.when(F.col("name") == "ul", 1).when(F.col("name") == "/ul", -1).otherwise(0)).over(over)
    told = tags.withColumn("object", F.last(opened, ignorenulls=True).over(over)).withColumn("depth", depth.cast("int"))
    params = told.where("name = 'param' AND object.node >= 0").select("file", "i", "object.*", ascii_lower(attribute(F.col("attrs"), "name")).alias("k"), attribute(F.col("attrs"), "value").alias("v"))
    properties = params.where("kind = 'text/site properties'").select("file", F.col("i").alias("ord"), F.col("k").alias("name"), F.col("v").alias("value"))
    gathered = params.where("kind = 'text/sitemap'").groupBy("file", "node").agg(F.array_sort(F.collect_list(F.struct("i", "k", "v"))).alias("p"))
    gathered = gathered.select("file", "node", F.transform("p", lambda x: F.struct(x["k"], x["v"])).alias("params"))
    items = told.where("name = 'object' AND object.kind = 'text/sitemap'").select("file", F.col("i").alias("node"), "depth")
    # Of items one level up, the last before a node; levels are few, so each is looked up in a map of level to last item.
    up = items.withColumnRenamed("node", "parent").withColumn("depth", F.col("depth") + 1)
    both = items.withColumn("parent", F.lit(None).cast("int")).select("file", "depth", F.col("node").alias("i"), "parent").union(up.select("file", "depth", F.col("parent").alias("i"), "parent"))
    placed = both.withColumn("last", F.last("parent", ignorenulls=True).over(Window.partitionBy("file", "depth").orderBy("i"))).where("parent IS NULL").select("file", F.col("i").alias("node"), F.col("last").alias("parent"), "depth")
    ordinal = F.row_number().over(Window.partitionBy("file", "parent").orderBy("node")) - 1
    return placed.withColumn("ordinal", ordinal.cast("long")).join(gathered, ["file", "node"], "left").select("file", "node", "parent", "ordinal", "depth", "params"), properties


def param(name: str) -> Column:
    """The first of an item's params of a name, or an empty text."""
    return F.coalesce(F.get(F.filter("params", lambda p: p["k"] == name), F.lit(0))["v"], F.lit(""))


def link_objects(pages: DataFrame) -> DataFrame:
    """(file, ord, kind, value) of keywords and associative links in pages' objects."""
    tags = pages.repartition("file").select("file", F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("ord", "tag"))
    tags = tags.withColumn("name", ascii_lower(F.regexp_extract("tag", r"^<\s*(/?[A-Za-z0-9]+)", 1))).where(F.col("name").isin("object", "/object", "param"))
    inside = F.last(F.when(F.col("name") != "param", F.col("name") == "object"), ignorenulls=True).over(Window.partitionBy("file").orderBy("ord"))
    tags = tags.withColumn("inside", inside).where("inside AND name = 'param'").withColumn("attrs", attributes(F.regexp_replace("tag", r"^<\s*[A-Za-z0-9]+|>$", "")))
    told = tags.select("file", "ord", ascii_lower(attribute(F.col("attrs"), "name")).alias("kind"), attribute(F.col("attrs"), "value").alias("value"))
    return told.where(F.col("kind").isin("keyword", "alink name") & (F.col("value") != ""))


def locals_of(items: DataFrame) -> DataFrame:
    """(file, place, local): all targets of a sitemap's items, numbered in order of its tags."""
    each = items.select("file", "node", F.posexplode("params").alias("k", "p")).where("p.k = 'local' AND p.v <> ''")
    place = F.row_number().over(Window.partitionBy("file").orderBy("node", "k")) - 1
    return each.select("file", place.cast("long").alias("place"), F.col("p.v").alias("local"))


def default_window(told: DataFrame, defined: DataFrame) -> DataFrame:
    """(file, window): the window that option names, else the first that is defined; sections of files each."""
    named = options(told).where("key = 'default window' AND value <> ''").select("file", F.col("value").alias("named"))
    first = windows(defined).groupBy("file").agg(F.min_by("type", "ord").alias("first"))
    return first.join(named, "file", "full").select("file", F.coalesce("named", "first").alias("window"))
