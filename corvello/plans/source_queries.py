"""Driver queries of the operators that read and write texts and archives, and the same in DuckDB's SQL.

The driver's tables hold no project files, sitemaps or archives, so each query first writes its table's rows in such a form
and then reads that; its SQL takes the rows as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvello.functions.text import is_yes, parse_int, parse_lcid, stem, utf16le, varint_bytes, window_bits
from corvello.operators import archive, catalog
from corvello.plans.build import is_html, is_list
from corvello.sources import container, encoding, project


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _lines(rows: DataFrame, section: str, *lines: Column) -> DataFrame:
    """A project file for each of rows (file, at): a heading and lines in order of ``at``; each row's text is cut as a file's is."""
    told = rows.select("file", "at", F.concat_ws("\r\n", F.when(F.col("at") == 0, f"; written here\n[{section}]").otherwise("\t"), *lines).alias("value"))
    cut = told.select("file", "at", F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("k", "line"))
    return project.sections(cut.select("file", (F.col("at") * 10 + F.col("k")).alias("ord"), "line"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in files of 16 consecutive ones, with their place there."""
    rows = table(spark, sf_dir, "supplier").withColumn("n", F.col("s_suppkey"))
    return rows.withColumn("file", F.floor(F.col("n") / 16).cast("string")).withColumn("at", F.col("n") % 16)


def project_options(spark, sf_dir):
    """Options of project files: the last one of a key wins, keys in lower case."""
    rows = _suppliers(spark, sf_dir)
    key = _text("Key ", F.col("at") % 3)
    return project.options(_lines(rows, "OPTIONS", _text(key, " = ", F.col("s_name"), "="), _text("; ", F.col("s_name")), _text("  KEY X", F.col("at"), "=", F.col("s_suppkey"), "  ")))


def project_files(spark, sf_dir):
    """Files of project files: each path once, whatever its case and slashes (A1, A5)."""
    rows = _suppliers(spark, sf_dir)
    return project.files(_lines(rows, "FILES", _text("Dir\\", F.col("at") % 5, ".htm"), _text("DIR/", F.col("at"), ".HTM"))).select("file", "ord", "path")


def project_aliases(spark, sf_dir):
    """Aliases of project files, without comments and includes (A2)."""
    rows = _suppliers(spark, sf_dir)
    return project.aliases(_lines(rows, "ALIAS", _text(F.col("s_name"), " = a\\", F.col("s_suppkey"), ".htm ; ", F.col("s_name")), _text("#include more=x"))).select("file", "name", "target")


def project_maps(spark, sf_dir):
    """Numbers of project files' maps, decimal, hexadecimal and broken ones."""
    rows = _suppliers(spark, sf_dir)
    number = F.when(F.col("at") % 3 == 0, _text("0x", F.hex("s_suppkey"))).when(F.col("at") % 3 == 1, F.col("s_suppkey").cast("string")).otherwise(_text("n", F.col("s_suppkey")))
    return project.maps(_lines(rows, "MAP", _text("#define ID_", F.col("s_suppkey"), " \t", number))).select("file", "name", "id")


def project_windows(spark, sf_dir):
    """Window definitions with quoted texts, missing numbers and rectangles (A4)."""
    rows = _suppliers(spark, sf_dir)
    n = F.col("s_suppkey")
    line = _text("w", n, '="Window, ', n, '","toc.hhc",,"start\\', n, '.htm",,,,,,', F.when(n % 2 == 0, _text("0x", F.hex(n))).otherwise(""), ",", n, ",,[", n, ",", -n, ",,", n * 2, "],,", n * 3)
    found = project.windows(_lines(rows, "WINDOWS", line))
    return found.select("file", "type", "caption", "toc", "default_file", "nav_style", "nav_width", "buttons", F.array_join("rect", ",").alias("rect"), "ex_styles", "valid")


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each nation: an item for it, and below it one for each of its customers, in order, every third with a child."""
    item = lambda name, local: _text('<LI> <OBJECT type="text/sitemap">\n<param name="Name" value="', name, '"><param value=\'', local, "' name=Local></OBJECT>")
    customer, key = F.replace("c_name", F.lit("#"), F.lit("&#35;&amp;amp;")), F.col("c_custkey")
    child = F.when(key % 3 == 0, _text("<UL>", item(_text("child &#x41;&unknown;"), _text("sub/", key, ".htm")), "</ul>")).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.concat(item(customer, _text(key, ".htm")), child).alias("t")))), lambda x: x["t"]), "\n").alias("items"))
    nations = table(spark, sf_dir, "nation").join(rows, F.col("n_nationkey") == F.col("c_nationkey"))
    head = _text('<!-- list --><object type="text/site properties"><param name="Region" value="', F.col("n_regionkey"), '"></object><ul>')
    return nations.select(F.col("n_nationkey").cast("string").alias("file"), F.concat(head, item(F.col("n_name"), F.lit("")), F.lit("<ul>"), F.col("items"), F.lit("</ul></ul>")).alias("html"))


def sitemap_items(spark, sf_dir):
    """Items of sitemaps with their parents' names and their depth."""
    items = project.sitemap(_sitemaps(spark, sf_dir))[0].select("file", "node", "parent", "ordinal", "depth", project.param("name").alias("name"), project.param("local").alias("local"))
    above = items.select("file", F.col("node").alias("parent"), F.col("name").alias("parent_name"))
    return items.join(above, ["file", "parent"], "left").select("file", "name", "local", "parent_name", "ordinal", "depth")


def sitemap_properties(spark, sf_dir):
    """Properties of sitemaps."""
    return project.sitemap(_sitemaps(spark, sf_dir))[1].select("file", "name", "value")


def sitemap_locals(spark, sf_dir):
    """All targets of a sitemap's items, in order of the tags."""
    items = project.sitemap(_sitemaps(spark, sf_dir))[0]
    return project.locals_of(items)


def link_objects(spark, sf_dir):
    """Keywords and associative links in pages' objects."""
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    html = _text('<param name="keyword" value="outside">', F.coalesce("html", F.lit("")), '<OBJECT type="any"><PARAM name="Keyword" value="word ', n % 10, ' &gt; ', n, '"><param name=\'ALink Name\' value=l', n, '><param name="Keyword" value=""><param name="Font" value="x"></object><param name="keyword" value="after">')
    found = project.link_objects(pages.select(n.cast("string").alias("file"), html.alias("html")))
    return found.select("file", "kind", "value")


def path_kinds(spark, sf_dir):
    """What files are by their paths, and archives' stems."""
    n = F.col("p_partkey")
    ending = F.element_at(F.array(*map(F.lit, (".htm", ".HTML", ".hhc", ".HHK", ".css", ".xhtml", ""))), (n % 7 + 1).cast("int"))
    path = _text("dir\\Sub.d/", F.col("p_brand"), ending)
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", is_html(F.col("path")).alias("html"), is_list(F.col("path")).alias("list"), stem(F.col("path")).alias("stem"))


def scalar_numbers(spark, sf_dir):
    """Numbers and switches of options, sizes of coded numbers and windows."""
    n = F.col("c_custkey")
    word = F.element_at(F.array(*map(F.lit, ("Yes", " true ", "1", "no", "", "yes!"))), (n % 6 + 1).cast("int"))
    language = F.when(n % 4 == 0, _text("0x", F.hex(n), " English")).when(n % 4 == 1, "none").otherwise(_text(" ", n, " x"))
    colour = F.when(n % 3 != 0, _text("0x", F.hex(n * 1000)))
    rows = table(spark, sf_dir, "customer")
    return rows.select(n, parse_lcid(language).alias("lcid"), is_yes(word).alias("yes"), varint_bytes(n * n * 100).alias("varint_bytes"), window_bits(n * 50).alias("window_bits"), F.when(colour.isNotNull(), parse_int(colour)).alias("colour"))


def language_codepages(spark, sf_dir):
    """Codepages of language numbers, and whether they are double-byte ones."""
    lcid = F.element_at(F.array(*map(F.lit, (0x409, 0x419, 0x404, 0x804, 0x411, 0x412, 0x41F, 0x408, 0x40D, 0x401, 0x425, 0x41E, 0x1004, 0x815))), (F.col("c_custkey") % 14 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", lcid.alias("lcid"))
    codepage = encoding.codepage_for_lcid(F.col("lcid"))
    return rows.select("c_custkey", "lcid", codepage.alias("codepage"), encoding.is_dbcs(codepage).alias("dbcs"))


def decoded_pages(spark, sf_dir):
    """Pages that come as bytes in several encodings, with a mark, a declared charset, as plain UTF-8 or in a codepage."""
    n = F.col("page_id") % 6
    mark = lambda m, name: F.concat(F.unhex(F.lit(m)), F.encode("text", name))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "(?i)charset", "chars")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(text, F.lit("éü")).alias("text"))
    broken = F.concat(F.encode(F.concat(F.lit("charset=utf-8 "), "text"), "UTF-8"), F.unhex(F.lit("FFE9")))
    data = F.when(n == 0, mark("EFBBBF", "UTF-8")).when(n == 1, mark("FFFE", "UTF-16LE")).when(n == 2, mark("FEFF", "UTF-16BE")).when(n == 3, F.encode("text", "UTF-8")).when(n == 4, broken).otherwise(F.unhex(F.lit("636166E920E0")))
    plain = rows.select("page_id", encoding.decoded(data, F.when(n == 5, 1251).otherwise(1252)).alias("text"))
    return plain.select("page_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


def encoded_names(spark, sf_dir):
    """Names in codepages, with ? for what they lack, and as UTF-16."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" éЖ\U0001f600")).alias("name"))
    codepage = F.element_at(F.array(*map(F.lit, (1252, 1251, 932, 65001))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return rows.select("c_custkey", F.hex(encoding.encoded("name", codepage)).alias("bytes"), F.hex(utf16le(F.col("name"))).alias("wide"))


#: Pages of an archive.
PAGES = 50


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, data): an archive for each PAGES consecutive pages, every second one with a compressed section."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit(".HTM")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["page_id"].iloc[0]) // PAGES
        files = {n: bytes(c) for n, c in zip(pdf["name"], pdf["content"], strict=True)} | {"/empty": b"", "::Info": str(number).encode()}
        return pd.DataFrame([(str(number), container.archive_bytes(files, compressed=number % 2 == 1))], columns=["path", "data"])

    return pages.groupBy(F.floor(F.col("page_id") / PAGES)).applyInPandas(pack, "path string, data binary")


def archive_round_trip(spark, sf_dir):
    """Archives that are written and read again, plain and compressed ones: every entry and its content."""
    found = container.entries(_archives(spark, sf_dir), content=True).where("startswith(name, '/') AND length > 0")
    return found.select("path", "name", "section", F.col("length").alias("size"), F.md5("content").alias("digest"))


def archive_one_entry(spark, sf_dir):
    """One entry of each archive by its exact name."""
    found = container.entries(_archives(spark, sf_dir), content=True, names=["::Info", "/EMPTY"])
    return found.select("path", "name", F.col("content").cast("string").alias("content"))


def directory_order(spark, sf_dir):
    """An archive's directory in its order: by name whatever the case (J1), over the entries of both sections (K5)."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/P"), F.col("page_id").cast("string")).alias("name"), F.lit(1).alias("section"))
    meta = table(spark, sf_dir, "nation").select(F.concat(F.lit("/p"), F.col("n_nationkey").cast("string"), F.lit("#"), F.col("n_name")).alias("name"), F.lit(0).alias("section"))
    return archive.sorted_directory(meta.unionByName(pages)).select("rank", "name", "section")


def member_sources(spark, sf_dir):
    """Where a collection's members come from: flat or nested projects, else an archive that was built before."""
    n = F.col("c_custkey")
    wanted = table(spark, sf_dir, "customer").select(F.col("c_name").alias("member"), _text(F.col("c_name"), ".hhp").alias("flat"), _text(F.col("c_name"), "/", F.col("c_name"), ".hhp").alias("nested"), _text(F.col("c_name"), ".chm").alias("prebuilt"))
    listed = table(spark, sf_dir, "customer").select(F.explode(F.array(*(F.when(n % m == 0, _text(F.col("c_name"), *more)) for m, more in ((5, (".hhp",)), (3, ("/", F.col("c_name"), ".hhp")), (2, (".chm",)))))).alias("path")).where("path IS NOT NULL")
    return archive.chosen_sources(wanted, listed)


def keyword_order(spark, sf_dir):
    """Keywords in their order with the number of each one's data: the list's before the pages', then as they come."""
    entries = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 2).cast("int").alias("source_rank"), F.col("c_custkey").alias("ord"), F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("keyword"), (F.col("c_custkey") % 30).alias("topic_id"))
    return catalog.keyword_order(catalog.keyword_index(entries))


def context_order(spark, sf_dir):
    """Context ids in ascending order."""
    defined = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 7919 % 1009).alias("id"))
    aliases = defined.where("ord % 4 <> 0").select("ord", "name", F.concat("name", F.lit(".htm")).alias("file"))
    return catalog.ordered_index(catalog.context_ids(defined, aliases), ["id"], "rank")


def default_windows(spark, sf_dir):
    """The window that opens: the option, else the first that is defined."""
    rows = _suppliers(spark, sf_dir)
    told = _lines(rows, "WINDOWS", _text("w", F.col("s_suppkey"), "=Title"))
    options = _lines(rows.where("file % 2 = 0"), "OPTIONS", F.when(F.col("at") == 1, _text("Default Window=w", F.col("s_suppkey"))))
    return project.default_window(options, told)


QUERIES = {f.__name__: f for f in (
    project_options, project_files, project_aliases, project_maps, project_windows, sitemap_items, sitemap_properties, sitemap_locals, link_objects, path_kinds, scalar_numbers, language_codepages,
    decoded_pages, encoded_names, archive_round_trip, archive_one_entry, directory_order, member_sources, keyword_order, context_order, default_windows,
)}


_S = "s AS (SELECT s_suppkey AS n, s_name, (s_suppkey // 16)::VARCHAR AS file, s_suppkey % 16 AS spot FROM supplier)"
_CUSTOMERS = "c AS (SELECT c_custkey AS k, c_nationkey::VARCHAR AS file, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer)"
_ITEM = "replace(c_name, '#', '#&amp;')"


def _hex_each(text: str, of: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda x: {of}), '')"


ORACLE_SQL = {
    "project_options": f"""WITH {_S} SELECT file, 'key ' || spot % 3 AS key, arg_max(s_name, spot) || '=' AS value FROM s GROUP BY ALL
        UNION ALL SELECT file, 'key x' || spot, n::VARCHAR FROM s""",
    "project_files": f"""WITH {_S}, p AS (SELECT file, spot * 10 + CASE WHEN spot = 0 THEN 2 ELSE 1 END AS ord, 'Dir/' || spot % 5 || '.htm' AS path FROM s UNION ALL SELECT file, spot * 10 + CASE WHEN spot = 0 THEN 3 ELSE 2 END, 'DIR/' || spot || '.HTM' FROM s)
        SELECT file, min(ord) AS ord, arg_min(path, ord) AS path FROM p GROUP BY file, lower(path)""",
    "project_aliases": f"WITH {_S} SELECT file, s_name AS name, 'a/' || n || '.htm' AS target FROM s",
    "project_maps": f"WITH {_S} SELECT file, 'ID_' || n AS name, CASE WHEN spot % 3 = 2 THEN 0 ELSE n END AS id FROM s",
    "project_windows": f"""WITH {_S} SELECT file, 'w' || n AS type, 'Window, ' || n AS caption, 'toc.hhc' AS toc, 'start/' || n || '.htm' AS default_file, CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS nav_style, n AS nav_width,
        0::BIGINT AS buttons, n || ',' || -n || ',0,' || n * 2 AS rect, n * 3 AS ex_styles, (32 + 16 + 8 + CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS valid FROM s""",
    "sitemap_items": f"""WITH {_CUSTOMERS} SELECT file, {_ITEM} AS name, k || '.htm' AS local, n_name AS parent_name, place AS ordinal, 2 AS depth FROM c JOIN nation ON n_nationkey = file::INT
        UNION ALL SELECT file, 'child A&unknown;', 'sub/' || k || '.htm', {_ITEM}, 0, 3 FROM c WHERE k % 3 = 0
        UNION ALL SELECT DISTINCT file, n_name, '', NULL, 0, 1 FROM c JOIN nation ON n_nationkey = file::INT""",
    "sitemap_properties": f"WITH {_CUSTOMERS} SELECT DISTINCT file, 'region' AS name, n_regionkey::VARCHAR AS value FROM c JOIN nation ON n_nationkey = file::INT",
    "sitemap_locals": f"""WITH {_CUSTOMERS}, l AS (SELECT file, k, 0 AS sub, k || '.htm' AS local FROM c UNION ALL SELECT file, k, 1, 'sub/' || k || '.htm' FROM c WHERE k % 3 = 0)
        SELECT file, row_number() OVER (PARTITION BY file ORDER BY k, sub) - 1 AS place, local FROM l""",
    "link_objects": "SELECT page_id::VARCHAR AS file, 'keyword' AS kind, 'word ' || page_id % 10 || ' > ' || page_id AS value FROM pages UNION ALL SELECT page_id::VARCHAR, 'alink name', 'l' || page_id FROM pages",
    "path_kinds": """SELECT p_partkey, p_partkey % 7 IN (0, 1) AS html, p_partkey % 7 IN (2, 3) AS list, p_brand AS stem FROM part""",
    "scalar_numbers": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 OR c_custkey = 0 THEN 1033 ELSE c_custkey END AS lcid, c_custkey % 6 < 3 AS yes, greatest(1, ceil(length(bin(c_custkey * c_custkey * 100)) / 7))::BIGINT AS varint_bytes,
        (CASE WHEN c_custkey * 50 <= 1 THEN 0 ELSE length(bin(c_custkey * 50 - 1)) END)::BIGINT AS window_bits, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 1000 END AS colour FROM customer""",
    "language_codepages": """WITH l AS (SELECT c_custkey, [1033, 1049, 1028, 2052, 1041, 1042, 1055, 1032, 1037, 1025, 1061, 1054, 4100, 2069][c_custkey % 14 + 1] AS lcid, [1252, 1251, 950, 936, 932, 949, 1254, 1253, 1255, 1256, 1257, 874, 936, 1250][c_custkey % 14 + 1] AS codepage FROM customer)
        SELECT c_custkey, lcid, codepage, codepage IN (932, 936, 949, 950) AS dbcs FROM l""",
    "decoded_pages": """WITH t AS (SELECT page_id, page_id % 6 AS n, regexp_replace(coalesce(html, ''), '(?i)charset', 'chars', 'g') || 'éü' AS text FROM pages),
        d AS (SELECT page_id, CASE WHEN n < 4 THEN text WHEN n = 4 THEN 'charset=utf-8 ' || text || 'ÿé' ELSE 'cafй а' END AS text FROM t) SELECT page_id, length(text) AS n, md5(text) AS digest FROM d""",
    "encoded_names": f"""WITH c AS (SELECT c_custkey, c_custkey % 4 AS n, c_name || ' éЖ😀' AS name FROM customer)
        SELECT c_custkey, CASE WHEN n IN (2, 3) THEN hex(encode(name)) WHEN n = 0 THEN {_hex_each("name", "CASE WHEN unicode(x) > 255 THEN '3F' ELSE printf('%02X', unicode(x)) END")}
            ELSE {_hex_each("name", "CASE WHEN x = 'Ж' THEN 'C6' WHEN unicode(x) > 127 THEN '3F' ELSE printf('%02X', unicode(x)) END")} END AS bytes,
            {_hex_each("name", "CASE WHEN unicode(x) > 65535 THEN '3DD800DE' ELSE printf('%02X%02X', unicode(x) % 256, unicode(x) // 256) END")} AS wide FROM c""",
    "archive_round_trip": f"""SELECT (page_id // {PAGES})::VARCHAR AS path, '/' || page_id || '.HTM' AS name, (page_id // {PAGES} % 2)::INT AS section, octet_length(encode(html))::BIGINT AS size, md5(html) AS digest FROM pages WHERE html <> ''""",
    "archive_one_entry": f"SELECT DISTINCT (page_id // {PAGES})::VARCHAR AS path, '::Info' AS name, (page_id // {PAGES})::VARCHAR AS content FROM pages",
    "directory_order": """WITH e AS (SELECT '/P' || page_id AS name, 1 AS section FROM pages UNION ALL SELECT '/p' || n_nationkey || '#' || n_name, 0 FROM nation)
        SELECT row_number() OVER (ORDER BY encode(lower(name)), name) - 1 AS rank, name, section FROM e""",
    "member_sources": """SELECT c_name AS member, CASE WHEN c_custkey % 5 = 0 THEN 'flat' WHEN c_custkey % 3 = 0 THEN 'nested' WHEN c_custkey % 2 = 0 THEN 'prebuilt' END AS source,
        CASE WHEN c_custkey % 5 = 0 THEN c_name || '.hhp' WHEN c_custkey % 3 = 0 THEN c_name || '/' || c_name || '.hhp' WHEN c_custkey % 2 = 0 THEN c_name || '.chm' END AS path FROM customer""",
    "keyword_order": """WITH e AS (SELECT (c_custkey % 2)::INT AS source_rank, c_custkey AS ord, lower(c_mktsegment || c_custkey % 40) AS sort_key FROM customer),
        k AS (SELECT source_rank, sort_key, min(ord) AS first FROM e GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY sort_key, source_rank, first) - 1 AS seq, sort_key, source_rank, (row_number() OVER (ORDER BY sort_key, source_rank, first) - 1) * 13 AS data FROM k""",
    "context_order": """WITH c AS (SELECT s_suppkey * 7919 % 1009 AS id, arg_max(s_name || '.htm', s_suppkey) AS file FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1) SELECT id, file, row_number() OVER (ORDER BY id) - 1 AS rank FROM c""",
    "default_windows": f"""WITH {_S} SELECT file, CASE WHEN file::INT % 2 = 0 AND count(*) > 1 THEN 'w' || min(n) FILTER (spot = 1) ELSE 'w' || min(n) END AS "window" FROM s GROUP BY file""",
}
