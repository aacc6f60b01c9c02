"""Building a project: discover its files, and make the catalog, contents, keyword, full-text and archive tables.

``build(spark, path)`` returns the tables by name and ``save`` writes them as Parquet; ``collection`` builds a master
project's members, of which a failing one is a row and not the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corvello.functions.text import ascii_lower, dir_of, parse_lcid, references, resolve, slashes, stem, title
from corvello.operators import archive, catalog, fulltext, trees
from corvello.storage import materialise
from corvello.sources import encoding, project


class BuildError(ValueError):
    """A project that cannot be built."""


@dataclass
class Settings:
    """What the options of a project say; each has a default."""

    options: dict[str, str]
    lcid: int
    codepage: int
    contents: str
    index: str

    def yes(self, name: str) -> bool:
        return self.options.get(name, "").strip().lower() in ("yes", "true", "1")


def is_html(path: Column) -> Column:
    low = ascii_lower(path)
    return low.contains(".ht") & ~low.contains(".hhc") & ~low.contains(".hhk")


def is_list(path: Column) -> Column:
    """Whether a path is that of a table of contents or of an index."""
    return ascii_lower(path).rlike(r"\.hh[ck]$")


def settings(rows: DataFrame) -> Settings:
    """The options, of which a project file has a handful."""
    found = {r.key: r.value for r in project.options(rows).select("key", "value").collect()}
    spark = rows.sparkSession
    lcid, codepage = spark.createDataFrame([(found.get("language", ""),)], "l string").select(parse_lcid(F.col("l")).alias("l")).select("l", encoding.codepage_for_lcid(F.col("l"))).first()
    return Settings(found, lcid, codepage, found.get("contents file", "").replace("\\", "/"), found.get("index file", "").replace("\\", "/"))


def stored(spark: SparkSession, folder: str, codepage: int) -> DataFrame:
    """(path, size, html) of all files below a folder; html is the decoded text of pages and sitemaps only."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    prefix = F.lit(folder.removeprefix("file:").rstrip("/") + "/")
    rows = raw.select(F.element_at(F.split(F.regexp_replace("path", "^file:/+", "/"), F.concat(F.lit("\\Q"), prefix, F.lit("\\E")), 2), 2).alias("path"), F.col("length").alias("size"), "content")
    told = is_html(F.col("path")) | is_list(F.col("path"))
    return rows.select("path", "size", F.when(told, encoding.decoded("content", F.lit(codepage))).alias("html"))


def discovered(listed: DataFrame, files: DataFrame, sitemaps: list[str]) -> tuple[DataFrame, DataFrame]:
    """Loaded files (ord, path, size, html) in breadth-first order, and paths (path, explicit) that do not exist.

    listed: (ord, path) of the project; a page's references resolve from its folder, a sitemap's from the root.
    Only files found in the last round are read for references.
    """
    key = ascii_lower(F.col("path")).alias("key")
    there = files.select(key, F.col("path").alias("real"), "size", "html")
    frontier = materialise(listed.select(key, "path", F.array("ord").alias("rank")), "found")
    seen, hop, lists = frontier.select("key", "path", "rank", F.lit(0).alias("hop")), 0, [s.lower() for s in sitemaps if s]
    local = F.transform(F.filter(project.attributes(F.col("tag")), lambda a: a["name"] == "value"), lambda a: a["value"])
    while True:
        hop += 1
        read = frontier.join(there, "key").where("html IS NOT NULL")
        pages = read.where(is_html(F.col("path")) & ~F.col("key").isin(*lists)) if lists else read.where(is_html(F.col("path")))
        refs = pages.select("rank", F.posexplode(F.concat(references(F.col("html"), "href"), references(F.col("html"), "src"))).alias("k", "ref"), dir_of(F.col("path")).alias("base"))
        if lists:
            tags = read.where(F.col("key").isin(*lists)).select("rank", F.posexplode(F.regexp_extract_all("html", F.lit(project.TAG), F.lit(0))).alias("k", "tag"))
            tags = tags.where(F.col("tag").rlike("(?i)^<\\s*param")).where(F.exists(project.attributes(F.col("tag")), lambda a: (a["name"] == "name") & (ascii_lower(a["value"]) == "local")))
            refs = refs.union(tags.select("rank", "k", F.coalesce(F.get(local, F.lit(0)), F.lit("")), F.lit("")))
        new = refs.select(resolve(F.col("base"), F.col("ref")).alias("path"), F.concat("rank", F.array(F.col("k").cast("long"))).alias("rank")).where("path <> ''")
        new = new.groupBy(key).agg(F.min(F.struct("rank", "path")).alias("f")).select("key", "f.path", "f.rank").join(seen, "key", "left_anti")
        frontier = materialise(new, "found")
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier.withColumn("hop", F.lit(hop)))
    missing = seen.join(there, "key", "left_anti").select("path", (F.col("hop") == 0).alias("explicit"))
    return catalog.ordered_index(seen.join(there, "key").select("hop", "rank", "path", "size", "html"), ["hop", "rank"], "ord").select("ord", "path", "size", "html"), missing


def _nodes(items: DataFrame) -> DataFrame:
    return items.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), "ordinal", project.param("name").alias("name"), slashes(project.param("local")).alias("local"))


def _keywords(loaded: DataFrame, topics: DataFrame, items: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyword and associative-link indexes, and topics with those that the index file adds."""
    pages = topics.select("topic_id", catalog.url_key(F.col("url")).alias("key"))
    found = project.link_objects(loaded.where(is_html(F.col("path"))).select(F.col("path").alias("file"), "html"))
    found = found.join(pages, catalog.url_key(F.col("file")) == F.col("key")).withColumn("at", F.col("topic_id") * (1 << 31) + F.col("ord"))
    entry = lambda kind: found.where(F.col("kind") == kind).select(F.lit(1).alias("source_rank"), F.col("at").alias("ord"), F.col("value").alias("keyword"), "topic_id")
    words, links_ = entry("keyword"), entry("alink name")
    if items is not None:
        paths = trees.levels(_nodes(items)).select(F.col("node").cast("int").alias("node"), "path")
        params = items.where(project.param("see also") == "").select("node", F.posexplode("params").alias("k", "p"))
        named = params.groupBy("node").agg(F.array_sort(F.collect_list(F.when(F.col("p.k") == "name", F.struct("k", F.col("p.v").alias("v"))))).alias("names"))
        local = params.where("p.k = 'local' AND p.v <> ''").join(named, "node")
        # The last name before a local is its topic's title.
        name = F.coalesce(F.try_element_at(F.filter("names", lambda n: n["k"] < F.col("k")), F.lit(-1))["v"], F.get("names", F.lit(0))["v"], F.lit(""))
        wanted = local.select("node", (F.col("node").cast("long") * (1 << 20) + F.col("k")).alias("ord"), name.alias("name"), slashes(F.col("p.v")).alias("url"))
        numbered, topics = catalog.looked_up_or_added(wanted, topics, -1)
        listed = paths.join(numbered, "node", "left").select(F.lit(0).alias("source_rank"), F.coalesce("ord", F.col("node").cast("long") * (1 << 20)).alias("ord"), F.col("path").alias("keyword"), "topic_id")
        words = listed.union(words)
    return catalog.keyword_index(words), catalog.keyword_index(links_), topics


def system(spark: SparkSession, told: Settings, flags: dict[str, int], window: str) -> DataFrame:
    """(code, value) metadata of a build."""
    texts = [(2, told.options.get("default topic", "").replace("\\", "/")), (3, told.options.get("title", "")), (16, told.options.get("default font", "")), (0, told.contents), (1, told.index), (5, window)]
    rows = [(9, "corvello"), (4, f"lcid={told.lcid} " + " ".join(f"{k}={v}" for k, v in sorted(flags.items()))), *((c, v) for c, v in texts if v)]
    return spark.createDataFrame(rows, "code int, value string")


def build(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of the project file at ``path``; a listed file that is missing is a BuildError."""
    rows = materialise(project.project(spark, path), "project")
    told, folder = settings(rows), path.rpartition("/")[0]
    listed = project.files(rows).select(F.col("ord").cast("long").alias("ord"), "path")
    extra = [(1 << 40 | k, p) for k, p in enumerate((told.contents, told.index)) if p]
    if extra:
        more = spark.createDataFrame(extra, "ord long, path string")
        listed = listed.union(more.join(listed.select(ascii_lower(F.col("path")).alias("k")), ascii_lower(F.col("path")) == F.col("k"), "left_anti"))
    if not listed.limit(1).count():
        raise BuildError("the project lists no files")
    loaded, missing = discovered(listed, stored(spark, folder, told.codepage), [told.contents, told.index])
    if lost := missing.where("explicit").limit(1).collect():
        raise BuildError(f"{lost[0].path} cannot be read")
    loaded = materialise(loaded, "loaded")
    pages = catalog.ordered_index(loaded.where(is_html(F.col("path"))).select("ord", title(F.col("html")).alias("title"), F.col("path").alias("url")), ["ord"], "topic_id")
    topics = pages.select("topic_id", F.nullif("title", F.lit("")).alias("title"), "url", catalog.in_contents(F.col("url"), F.col("title")).alias("in_contents"))
    n = topics.count()
    sitemaps = [p for p in (told.contents, told.index) if p]
    if sitemaps:
        topics = topics.union(spark.createDataFrame([(n + k, None, p, 2) for k, p in enumerate(sitemaps)], "topic_id long, title string, url string, in_contents int"))
    topics = materialise(topics, "topics")
    out: dict[str, DataFrame] = {"files": loaded.select("ord", "path", "size"), "missing": missing.where("NOT explicit").select("path")}

    def items(file: str) -> DataFrame | None:
        found = loaded.where(ascii_lower(F.col("path")) == file.lower()).select(F.col("path").alias("file"), "html") if file else None
        return None if found is None or not found.limit(1).count() else materialise(project.sitemap(found)[0], "items")

    toc, index = items(told.contents), items(told.index)
    if toc is not None and told.yes("binary toc"):
        nodes = _nodes(toc)
        contents = trees.contents(nodes)
        wanted = contents.join(nodes.select("node", "local"), "node").where("local <> ''").select("node", F.col("pos").alias("ord"), "name", F.col("local").alias("url"))
        numbered, topics = catalog.looked_up_or_added(wanted, topics, 2)
        out["toc"] = contents.join(numbered.select("node", "topic_id"), "node", "left")
        out["topic_toc"] = numbered.groupBy("topic_id").agg((F.max("ord") + 4096).alias("toc_pos"))  # the last node of a topic
        topics = materialise(topics, "topics")
    out["keywords"], out["alinks"], topics = _keywords(loaded, topics, index if told.yes("binary index") else None)
    out["topics"] = topics
    out["urls"] = catalog.first_topics(topics)
    out["strings"] = catalog.dictionary(topics, "title")
    defined, named = project.maps(rows).select("ord", "name", "id"), project.aliases(rows).select("ord", "name", F.col("target").alias("file"))
    out["context_ids"], out["context_unmatched"] = catalog.context_ids(defined, named), catalog.context_unmatched(defined, named)
    out["windows"] = project.windows(rows)
    window = project.default_window(rows, rows).first()
    if told.yes("full-text search"):
        runs = fulltext.runs(loaded.where(is_html(F.col("path"))).join(pages.select(F.col("url").alias("path"), "topic_id"), "path"), "topic_id", "html")
        runs = materialise(runs, "runs")
        words = materialise(fulltext.words(runs), "words")
        if words.limit(1).count():  # without a word there is no index
            out["postings"], out["doc_freq"], out["fts_stats"] = fulltext.postings(words), fulltext.doc_freq(words), fulltext.statistics(runs)
    entries = archive.directory(loaded.select("ord", F.concat(F.lit("/"), F.col("path")).alias("name"), F.lit(1).alias("section"), "size"))
    out["directory"], out["totals"] = entries, archive.totals(entries)
    flags = {"fts": int("postings" in out), "keywords": int(out["keywords"].limit(1).count() > 0), "alinks": int(out["alinks"].limit(1).count() > 0), "toc": int("toc" in out)}
    out["system"] = system(spark, told, flags, window.window if window else "")
    out["index_header"] = topics.agg(F.count(F.lit(1)).alias("topics")).withColumn("merge_files", F.lit(rows.where("section = 'merge files'").count()))
    for name in ("subsets", "infotypes", "merge files"):
        out[name.replace(" ", "_")] = project.files(rows, name).select("ord", F.col("path").alias("name"))
    return out


def save(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def output_path(project_path: str, options: dict[str, str], override: str = "") -> str:
    """Where a project's archive goes: what the caller says, else the option, else the project's own name."""
    folder, _, name = project_path.rpartition("/")
    told = options.get("compiled file", "").replace("\\", "/")
    return override or f"{folder}/{told or name.rpartition('.')[0] + '.chm'}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def collection(spark: SparkSession, master: str, out: str) -> DataFrame:
    """(member, ok, source, error) of a master project's members and, last, the master; tables go below ``out``.

    A member is a project beside the master (flat) or in a folder of its own name (nested), or an archive that was built
    before (prebuilt), which is taken as it is.
    """
    folder, told = master.rpartition("/")[0], project.sections(project.lines(spark, master))
    members = project.files(told, "merge files").select("ord", stem(F.col("path")).alias("member"))
    place = lambda *parts: F.concat(F.lit(folder + "/"), *parts)
    wanted = members.select("ord", "member", place("member", F.lit(".hhp")).alias("flat"), place("member", F.lit("/"), "member", F.lit(".hhp")).alias("nested"), place("member", F.lit(".chm")).alias("prebuilt"))
    # A collection has a handful of members.
    paths = [p for r in wanted.select("flat", "nested", "prebuilt").collect() for p in r if _exists(spark, p)]
    chosen = archive.chosen_sources(wanted, spark.createDataFrame([(p,) for p in paths], "path string"))
    results = []
    for r in [*wanted.select("ord", "member").join(chosen, "member").orderBy("ord").collect(), None]:
        member, source, path = (r.member, r.source, r.path) if r else (master.rpartition("/")[2], "master", master)
        error = None if source else f"no {member}.hhp and no prebuilt {member}.chm"
        if source not in (None, "prebuilt"):
            try:
                save(build(spark, path), f"{out}/{member}")
            except (BuildError, AnalysisException) as e:
                error = str(e)
        results.append((member, error is None, source, error))
    return spark.createDataFrame(results, "member string, ok boolean, source string, error string")
