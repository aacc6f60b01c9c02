"""The driver queries of the library's own operators and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvello.functions.text import LEXER, LOWER, UPPER, WORD, ascii_lower, charset, title, varint_bytes
from corvello.operators import archive, catalog, fulltext, links, trees
from corvello.plans import source_queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.words(fulltext.runs(table(spark, sf_dir, "pages"), "page_id", "html"))


def fts_words(spark, sf_dir):
    """Every indexed word of every page with its context and position."""
    return _page_words(spark, sf_dir)


def fts_postings(spark, sf_dir):
    """The inverted index: positions by word, context and page."""
    return fulltext.postings(_page_words(spark, sf_dir)).select("word", "ctx", "doc", "tf", F.array_join("positions", ",").alias("positions"))


def fts_doc_freq(spark, sf_dir):
    """Document and total frequency of every word and context (F2)."""
    return fulltext.doc_freq(_page_words(spark, sf_dir))


def fts_stats(spark, sf_dir):
    """Corpus statistics."""
    return fulltext.statistics(fulltext.runs(table(spark, sf_dir, "pages"), "page_id", "html"))


def plain_words_documents(spark, sf_dir):
    """Document and total frequency of the words of plain texts."""
    return fulltext.doc_freq(fulltext.plain_words(table(spark, sf_dir, "documents"), "doc_id", "text"))


def postings_order(spark, sf_dir):
    """The index in its order: word, body before title, page; with the bytes of its counts."""
    found = fulltext.postings(_page_words(spark, sf_dir)).select("word", "ctx", "doc", "tf")
    return catalog.ordered_index(found, ["word", "ctx", "doc"], "rank").select("rank", "word", "ctx", "doc", varint_bytes(F.col("tf")).alias("tf_bytes"))


def posting_gaps(spark, sf_dir):
    """Delta-coded documents and positions (H5)."""
    return fulltext.gaps(_page_words(spark, sf_dir)).select("word", "ctx", "doc", "pos", "doc_gap", "pos_gap")


def posting_code_bits(spark, sf_dir):
    """Sizes of the coded postings."""
    return fulltext.sizes(_page_words(spark, sf_dir))


def page_titles(spark, sf_dir):
    """Titles of pages."""
    return table(spark, sf_dir, "pages").select("page_id", title(F.col("html")).alias("title"))


def page_charsets(spark, sf_dir):
    """Charsets that pages declare."""
    return table(spark, sf_dir, "pages").select("page_id", charset(F.col("html")).alias("charset"))


def page_refs(spark, sf_dir):
    """All references of pages in order."""
    return links.refs(table(spark, sf_dir, "pages"), "page_id", "html")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the path of their URL, without a first slash."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.regexp_extract("url", "^[a-z]+://[^/]*/?([^?#]*)", 1).alias("path"))


def page_refs_resolved(spark, sf_dir):
    """What references mean from their page's directory."""
    return links.resolved(page_refs(spark, sf_dir), _paths(spark, sf_dir)).select("doc", "kind", "ordinal", "ref", "target")


def dangling_refs(spark, sf_dir):
    """Local targets that no page has."""
    return links.dangling(links.resolved(page_refs(spark, sf_dir), _paths(spark, sf_dir)), _paths(spark, sf_dir))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.topics(table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), title(F.col("html")).alias("title"), "url"))


def topics(spark, sf_dir):
    """Dense topic table (C4, H1)."""
    return _topics(spark, sf_dir)


def topic_upsert(spark, sf_dir):
    """Topics after looking up customers' names as URLs and appending those that are missing."""
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.concat(F.lit("/"), F.col("s_name"), F.lit(".htm")).alias("url"))
    return catalog.looked_up_or_added(wanted, _topics(spark, sf_dir), 2)[1]


def url_first_topic(spark, sf_dir):
    """First topic of each URL."""
    return catalog.first_topics(_topics(spark, sf_dir))


def string_dict(spark, sf_dir):
    """Dictionary of distinct titles (K4)."""
    return catalog.dictionary(page_titles(spark, sf_dir), "title")


def keyword_index(spark, sf_dir):
    """Keywords of two sources with their topics."""
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("source_rank"), F.col("doc_id").alias("ord"), F.concat_ws(" ", "lang", "source").alias("keyword"), (F.col("doc_id") % 97).alias("topic_id"))
    pages = page_titles(spark, sf_dir).select(F.lit(1).alias("source_rank"), F.col("page_id").alias("ord"), F.regexp_extract("title", r"^(\S*)", 1).alias("keyword"), F.col("page_id").alias("topic_id"))
    return catalog.keyword_index(docs.union(pages).where("keyword <> ''"))


def _contexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation")
    defined = nations.select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("id"))
    aliases = nations.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.concat("n_name", F.lit(".htm")).alias("file"))
    return defined, aliases


def context_ids(spark, sf_dir):
    """Context ids with the file of their alias."""
    return catalog.context_ids(*_contexts(spark, sf_dir))


def context_unmatched(spark, sf_dir):
    """Context names without alias."""
    return catalog.context_unmatched(*_contexts(spark, sf_dir))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    row = lambda node, parent, ordinal, name, local: (node.alias("node"), parent.alias("parent"), F.col(ordinal).cast("long").alias("ordinal"), F.col(name).alias("name"), local.alias("local"))
    none: Column = F.lit(None).cast("string")
    regions = table(spark, sf_dir, "region").select(*row(key("r", "r_regionkey"), none, "r_regionkey", "r_name", F.lit("")))
    nations = table(spark, sf_dir, "nation").select(*row(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_nationkey", "n_name", F.col("n_name")))
    customers = table(spark, sf_dir, "customer").select(*row(key("c", "c_custkey"), key("n", "c_nationkey"), "c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("")))
    return regions.union(nations).union(customers)


def tree_level_order(spark, sf_dir):
    """Table of contents in level order with positions and references."""
    return trees.contents(_tree(spark, sf_dir))


def tree_paths(spark, sf_dir):
    """Names of nodes under their ancestors' names, and where the last name begins."""
    found = trees.levels(_tree(spark, sf_dir))
    return found.select("node", "depth", "path", trees.char_index("path", "name").alias("char_index"))


def tree_siblings(spark, sf_dir):
    """Next siblings (H8)."""
    return trees.siblings(_tree(spark, sf_dir))


def conversation_paths(spark, sf_dir):
    """Conversations as chains: the depth of every turn, whose parent is the turn before."""
    turns = table(spark, sf_dir, "conversations").where("turn IS NOT NULL")
    node = lambda t: F.concat_ws("/", "conv_id", t)
    return trees.chain_paths(turns.select(node(F.col("turn")).alias("node"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent"), F.col("role").alias("name")))


def link_closure(spark, sf_dir):
    """All parts and suppliers that can be reached from part 1, with the least number of steps."""
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    seeds = spark.createDataFrame([("p1",)], "node string")
    return links.closure(seeds, pairs.union(pairs.select("dst", "src")))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = pages.select(F.col("page_id").alias("ord"), F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit("-"), F.regexp_extract("url", "([^/]*)$", 1)).alias("name"), F.when(F.col("page_id") % 5 == 0, 0).otherwise(1).alias("section"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    return archive.directory(files)


def archive_directory(spark, sf_dir):
    """An archive's entries with prefix-sum offsets in each section."""
    return _entries(spark, sf_dir)


def archive_list(spark, sf_dir):
    """What listing an archive shows."""
    return archive.listing(_entries(spark, sf_dir))


def archive_totals(spark, sf_dir):
    """Files and bytes of an archive."""
    return archive.totals(_entries(spark, sf_dir))


def collection_members(spark, sf_dir):
    """A collection's members with success or failure."""
    return archive.collection(table(spark, sf_dir, "documents").select(F.col("source").alias("member"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")))


def collection_summary(spark, sf_dir):
    """A collection's summary."""
    return archive.collection_summary(collection_members(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    fts_words, fts_postings, fts_doc_freq, fts_stats, plain_words_documents, postings_order, posting_gaps, posting_code_bits, page_titles, page_charsets, page_refs,
    page_refs_resolved, dangling_refs, topics, topic_upsert, url_first_topic, string_dict, keyword_index, context_ids, context_unmatched,
    tree_level_order, tree_paths, tree_siblings, conversation_paths, link_closure, archive_directory, archive_list, archive_totals, collection_members, collection_summary,
)} | source_queries.QUERIES


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


_EVENT = "CASE WHEN starts_with(tag, '{0}') THEN true WHEN starts_with(tag, '/{0}') THEN false END"
_LAST = "coalesce(last_value({0} IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND {1}), false)"
_RUNS = rf"""
    lexed AS (SELECT doc, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT page_id AS doc, regexp_extract_all(html, {_quoted(LEXER)}) AS t FROM pages)),
    tagged AS (SELECT *, CASE WHEN starts_with(token, '<') THEN {_lower("substr(token, 2, 8)")} END AS tag FROM lexed WHERE NOT starts_with(token, '<!--')),
    bodied AS (SELECT *, {_LAST.format(_EVENT.format("body"), "CURRENT ROW")} AS body, {_LAST.format(_EVENT.format("body"), "1 PRECEDING")} AS was,
        count(tag) OVER (PARTITION BY doc ORDER BY i) AS run FROM tagged),
    states AS (SELECT *, {_LAST.format("CASE WHEN NOT was THEN " + _EVENT.format("title") + " END", "CURRENT ROW")} AS title,
        {_LAST.format("CASE WHEN was THEN " + _EVENT.format("script") + " END", "CURRENT ROW")} AS script, {_LAST.format("CASE WHEN was THEN " + _EVENT.format("style") + " END", "CURRENT ROW")} AS style FROM bodied),
    pieces AS (SELECT doc, run, i, (title AND NOT body)::INT AS ctx, token, CASE WHEN regexp_matches(token, '^&[^;]*;$') THEN substr(token, 2, length(token) - 2) END AS name
        FROM states WHERE tag IS NULL AND ((title AND NOT body) OR (body AND NOT script AND NOT style))),
    decoded AS (SELECT *, CASE WHEN name IS NULL THEN token WHEN name = 'amp' THEN '&' WHEN name = 'lt' THEN '<' WHEN name = 'gt' THEN '>' WHEN name = 'quot' THEN '"' WHEN name = 'apos' THEN ''''
        WHEN regexp_matches(name, '^#[xX]\+?[0-9A-Fa-f]+$') AND ('0x' || regexp_extract(name, '([0-9A-Fa-f]+)$', 1))::BIGINT BETWEEN 1 AND 255 THEN chr(('0x' || regexp_extract(name, '([0-9A-Fa-f]+)$', 1))::INT)
        WHEN regexp_matches(name, '^#\+?[0-9]+$') AND regexp_extract(name, '([0-9]+)$', 1)::BIGINT BETWEEN 1 AND 255 THEN chr(regexp_extract(name, '([0-9]+)$', 1)::INT) ELSE ' ' END AS piece FROM pieces),
    runs AS (SELECT doc, run, max(ctx) AS ctx, string_agg(piece, '' ORDER BY i) AS text FROM decoded GROUP BY doc, run)"""


def _words_of(runs: str) -> str:
    return rf"""
    cut AS (SELECT doc, run, ctx, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM (SELECT doc, run, ctx, regexp_extract_all({_lower("text")}, {_quoted(WORD)}) AS t FROM {runs})),
    placed AS (SELECT doc, replace(w, '''', '') AS word, ctx, row_number() OVER (PARTITION BY doc ORDER BY run, k) - 1 AS pos FROM cut),
    words AS (SELECT * FROM placed WHERE length(word) <= 99)"""


_WORDS = f"WITH {_RUNS}, {_words_of('runs')}"
_GAPS = f"""{_WORDS}, dg AS (SELECT *, doc - lag(doc, 1, 0) OVER (PARTITION BY word, ctx ORDER BY doc) AS doc_gap FROM (SELECT DISTINCT word, ctx, doc FROM words)),
    gapped AS (SELECT w.word, w.ctx, w.doc, pos, doc_gap, pos - lag(pos, 1, 0) OVER (PARTITION BY w.word, w.ctx, w.doc ORDER BY pos) AS pos_gap FROM words w JOIN dg ON w.word = dg.word AND w.ctx = dg.ctx AND w.doc = dg.doc)"""


def _bits(x: str, root: int) -> str:
    m = f"(CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) END)"
    return f"(CASE WHEN {m} <= {root} THEN {1 + root} ELSE 2 * {m} - {root} END)"


_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?s)<[tT][iI][tT][lL][eE][^>]*>(.*?)</[tT][iI][tT][lL][eE]', 1), '[ \t\r\n]+', ' ', 'g'), ' ')"


def _refs_sql() -> str:
    each = []
    for kind in ("href", "src"):
        name = "".join(f"[{c}{c.upper()}]" for c in kind)
        p = _quoted(rf"(?:^|[^A-Za-z0-9_-]){name}\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>\"'][^\s>]*)")
        value = rf"regexp_replace(regexp_replace(m, '^[\s\S]?[a-zA-Z]+\s*=\s*', ''), {_quoted(chr(94) + chr(91) + chr(34) + chr(39) + chr(93))}, '')"
        each.append(f"SELECT doc, '{kind}' AS kind, unnest(v) AS ref, generate_subscripts(v, 1) - 1 AS ordinal FROM (SELECT page_id AS doc, list_filter(list_transform(regexp_extract_all(html, {p}), lambda m: {value}), lambda x: x <> '') AS v FROM pages)")
    return f"refs AS ({' UNION ALL '.join(each)})"


_PATHS = "paths AS (SELECT page_id AS doc, regexp_extract(url, '^[a-z]+://[^/]*/?([^?#]*)', 1) AS path FROM pages)"
_RESOLVED = rf"""WITH {_refs_sql()}, {_PATHS},
    cleaned AS (SELECT doc, kind, ordinal, ref, trim(ref) AS s, regexp_extract(path, '^(.*/)', 1) AS dir FROM refs JOIN paths USING (doc)),
    decoded AS (SELECT *, replace(url_decode(regexp_extract(s, '^([^#?]*)', 1)), '\', '/') AS p FROM cleaned),
    parted AS (SELECT *, CASE WHEN s = '' OR starts_with(s, '#') OR regexp_matches(s, '^[^/:]*:') OR p = '' THEN NULL WHEN starts_with(p, '/') THEN substr(p, 2) ELSE dir || p END AS full_path FROM decoded),
    resolved AS (SELECT doc, kind, ordinal, ref, CASE WHEN full_path IS NULL THEN '' ELSE
        coalesce((SELECT CASE WHEN starts_with(f, '!') THEN '' ELSE ltrim(f, '/') END FROM (SELECT list_reduce([''] || string_split(full_path, '/'), lambda a, x:
            CASE WHEN a = '!' OR x = '' OR x = '.' THEN a WHEN x = '..' THEN (CASE WHEN a = '' THEN '!' ELSE regexp_replace(a, '/[^/]*$', '') END) ELSE a || '/' || x END) AS f)), '') END AS target FROM parted)"""
_TOPICS = f"t AS (SELECT page_id, nullif({_TITLE}, '') AS title, url, row_number() OVER (ORDER BY page_id) - 1 AS topic_id FROM pages), topics AS (SELECT topic_id, title, url, CASE WHEN contains(url, '#') THEN 0 WHEN title IS NULL THEN 2 ELSE 6 END AS in_contents FROM t)"
_KEY = _lower("regexp_replace(url, '^/', '')")
_TREE = """tree AS (SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent, r_regionkey::BIGINT AS ordinal, r_name AS name, '' AS local FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name, n_name FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END FROM customer),
    levels AS (SELECT *, 0 AS depth, [ordinal] AS rank, name AS path FROM tree WHERE parent IS NULL
    UNION ALL SELECT t.*, l.depth + 1, list_append(l.rank, t.ordinal), l.path || ', ' || t.name FROM tree t JOIN levels l ON t.parent = l.node)"""
_ENTRIES = """entries AS (SELECT name, section, (sum(size) OVER (PARTITION BY section ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS "offset", size
    FROM (SELECT page_id, '/' || page_id || '-' || regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS section, octet_length(encode(coalesce(html, '')))::BIGINT AS size FROM pages))"""
_MEMBERS = """members AS (SELECT source AS member, count(*) AS files, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents GROUP BY source)"""

ORACLE_SQL = {
    "fts_words": f"{_WORDS} SELECT doc, word, ctx, pos::BIGINT AS pos FROM words",
    "fts_postings": f"{_WORDS} SELECT word, ctx, doc, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM words GROUP BY word, ctx, doc",
    "fts_doc_freq": f"{_WORDS} SELECT word, ctx, count(DISTINCT doc) AS doc_freq, count(*) AS total_freq FROM words GROUP BY word, ctx",
    "fts_stats": f"""{_WORDS}, k AS (SELECT word, ctx, count(*) AS n FROM words GROUP BY word, ctx)
        SELECT (SELECT count(DISTINCT doc) FROM runs WHERE text <> '') AS indexed_files, coalesce(sum(n), 0)::BIGINT AS total_words, coalesce(sum(n * octet_length(encode(word))), 0)::BIGINT AS total_word_bytes,
        coalesce(max(octet_length(encode(word))), 0)::BIGINT AS longest_word, count(*) AS distinct_words, coalesce(sum(octet_length(encode(word))), 0)::BIGINT AS distinct_word_bytes FROM k""",
    "plain_words_documents": f"WITH d AS (SELECT doc_id AS doc, 1 AS run, 0 AS ctx, text FROM documents WHERE text IS NOT NULL), {_words_of('d')} SELECT word, ctx, count(DISTINCT doc) AS doc_freq, count(*) AS total_freq FROM words GROUP BY word, ctx",
    "postings_order": f"{_WORDS}, p AS (SELECT word, ctx, doc, count(*) AS tf FROM words GROUP BY word, ctx, doc) SELECT row_number() OVER (ORDER BY encode(word), ctx, doc) - 1 AS rank, word, ctx, doc, ceil(length(bin(tf)) / 7)::BIGINT AS tf_bytes FROM p",
    "posting_gaps": f"{_GAPS} SELECT word, ctx, doc, pos::BIGINT AS pos, doc_gap::BIGINT AS doc_gap, pos_gap::BIGINT AS pos_gap FROM gapped",
    "posting_code_bits": f"""{_GAPS}, s AS (SELECT word, ctx, doc, doc_gap, count(*) AS tf, sum({_bits("pos_gap", 5)}) AS pb FROM gapped GROUP BY word, ctx, doc, doc_gap),
        b AS (SELECT word, ctx, doc, ({_bits("doc_gap", 2)} + {_bits("tf", 1)} + pb)::BIGINT AS bits FROM s) SELECT word, ctx, doc, bits, ceil(bits / 8)::BIGINT AS bytes FROM b""",
    "page_titles": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_charsets": rf"""SELECT page_id, regexp_extract({_lower("substr(html, 1, 2048)")}, 'charset\s*=\s*["'']?([a-z0-9_-]+)', 1) AS charset FROM pages""",
    "page_refs": f"WITH {_refs_sql()} SELECT doc, kind, ordinal::BIGINT AS ordinal, ref FROM refs",
    "page_refs_resolved": f"{_RESOLVED} SELECT doc, kind, ordinal::BIGINT AS ordinal, ref, target FROM resolved",
    "dangling_refs": f"{_RESOLVED} SELECT target, count(*) AS n FROM resolved WHERE target <> '' AND {_lower('target')} NOT IN (SELECT {_lower('path')} FROM paths) GROUP BY target",
    "topics": f"WITH {_TOPICS} SELECT topic_id::BIGINT AS topic_id, title, url, in_contents FROM topics",
    "topic_upsert": f"""WITH {_TOPICS}, w AS (SELECT s_suppkey, s_name, '/' || s_name || '.htm' AS url FROM supplier), new AS (SELECT * FROM w WHERE {_KEY} NOT IN (SELECT {_KEY} FROM topics))
        SELECT topic_id::BIGINT AS topic_id, title, url, in_contents FROM topics UNION ALL
        SELECT ((SELECT count(*) FROM topics) + row_number() OVER (ORDER BY s_suppkey) - 1)::BIGINT, s_name, url, 2 FROM new""",
    "url_first_topic": f"WITH {_TOPICS} SELECT {_KEY} AS url_key, min(topic_id)::BIGINT AS topic_id FROM topics GROUP BY 1",
    "string_dict": f"WITH v AS (SELECT {_TITLE} AS value FROM pages UNION SELECT '') SELECT (row_number() OVER (ORDER BY encode(value)) - 1)::BIGINT AS id, value FROM v",
    "keyword_index": rf"""WITH e AS (SELECT 0 AS source_rank, doc_id AS ord, concat_ws(' ', lang, source) AS keyword, doc_id % 97 AS topic_id FROM documents
        UNION ALL SELECT 1, page_id, regexp_extract({_TITLE}, '^(\S*)', 1), page_id FROM pages), k AS (SELECT *, {_lower("keyword")} AS sort_key FROM e WHERE keyword <> ''),
        f AS (SELECT source_rank, sort_key, arg_min(keyword, ord) AS display FROM k GROUP BY 1, 2)
        SELECT source_rank, sort_key, display, topic_id, min(ord) AS ord FROM k JOIN f USING (source_rank, sort_key) GROUP BY ALL""",
    "context_ids": "SELECT n_regionkey::BIGINT AS id, arg_max(n_name || '.htm', n_nationkey) AS file FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1",
    "context_unmatched": "SELECT n_name AS name, n_regionkey::BIGINT AS id FROM nation WHERE n_nationkey % 3 = 0",
    "tree_level_order": f"""WITH RECURSIVE {_TREE}, s AS (SELECT *, node IN (SELECT parent FROM tree) AS has_children, lead(node) OVER (PARTITION BY parent ORDER BY ordinal) AS nxt, (local <> '')::BIGINT AS hit FROM levels),
        z AS (SELECT *, CASE WHEN has_children THEN 28 ELSE 20 END AS size FROM s),
        p AS (SELECT *, sum(size) OVER w - size AS pos, sum(hit) OVER w AS seq FROM z WINDOW w AS (ORDER BY depth, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT node, depth, name, pos::BIGINT AS pos, seq::BIGINT AS seq, (CASE WHEN has_children THEN 4 ELSE 0 END + 8 * hit)::BIGINT AS props,
            coalesce((SELECT q.pos + 4096 FROM p q WHERE q.node = p.parent), 0)::BIGINT AS parent_ref, (CASE WHEN nxt IS NULL THEN 0 ELSE 4096 + pos + size END)::BIGINT AS next_ref,
            coalesce(c.child + 4096, 0)::BIGINT AS first_child
        FROM p LEFT JOIN (SELECT parent AS up, min(pos) AS child FROM p GROUP BY parent) c ON c.up = p.node""",
    "tree_paths": f"WITH RECURSIVE {_TREE} SELECT node, depth, path, (octet_length(encode(path)) - octet_length(encode(name)))::BIGINT AS char_index FROM levels",
    "tree_siblings": f"WITH RECURSIVE {_TREE} SELECT node, parent, node IN (SELECT parent FROM tree WHERE parent IS NOT NULL) AS has_children, next_sibling IS NULL AS last, next_sibling FROM (SELECT *, lead(node) OVER (PARTITION BY parent ORDER BY ordinal) AS next_sibling FROM tree)",
    "conversation_paths": """WITH RECURSIVE l AS (SELECT conv_id, turn, role AS path FROM conversations WHERE turn = 0
        UNION ALL SELECT c.conv_id, c.turn, l.path || ', ' || c.role FROM conversations c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn + 1)
        SELECT conv_id || '/' || turn AS node, turn AS depth, path FROM l""",
    "link_closure": """WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
        c AS (SELECT 'p1' AS node, 0 AS hop UNION SELECT b.dst, c.hop + 1 FROM c JOIN b ON b.src = c.node WHERE c.hop < 40) SELECT node, min(hop)::BIGINT AS hop FROM c GROUP BY node""",
    "archive_directory": f'WITH {_ENTRIES} SELECT name, section, "offset", size FROM entries',
    "archive_list": f"WITH {_ENTRIES} SELECT CASE WHEN section <> 0 THEN 'lzx' ELSE 'raw' END AS kind, size, name FROM entries WHERE starts_with(name, '/') AND size > 0",
    "archive_totals": f'WITH {_ENTRIES} SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, coalesce(max("offset" + size), 0)::BIGINT AS "end" FROM entries',
    "collection_members": f"WITH {_MEMBERS} SELECT member, files, bytes, bytes > 0 AS ok, CASE WHEN bytes = 0 THEN 'nothing to build' END AS error FROM members",
    "collection_summary": f"WITH {_MEMBERS} SELECT count(*) AS members, count(*) FILTER (bytes = 0) AS failed, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM members",
} | source_queries.ORACLE_SQL
