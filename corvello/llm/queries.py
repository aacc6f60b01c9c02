"""The thin driver queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvello.llm import ann, chat_tools, decontaminate, language_id, license_scan, neardup, packing, pii, toxicity, warc
from corvello.llm.common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    langs, profiles = language_id.prototypes(docs.where("NOT held_out"))
    return language_id.identify(docs, langs, profiles, ["doc_id", "held_out"])


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.formatted(table(spark, sf_dir, "conversations"))


#: What the derived conversations of tool_call_chains may call.
RATE = {"tools": [{"name": "rate", "parameters": {"type": "object", "required": ["balance"], "properties": {"balance": {"type": "number", "minimum": 0}, "segment": {"enum": ["BUILDING", "MACHINERY"]}}}}]}


def tool_call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 on conversations that have calls, results and schemas: each customer is a call in its nation's conversation,
    which names the call of half its number; every third has a result.  Number 0 names itself, which is a cycle."""
    customers, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    arguments = F.struct(F.col("c_mktsegment").alias("segment"), F.floor("c_acctbal").alias("balance"), F.concat(F.lit("${c"), F.floor(key / 2).cast("string"), F.lit("}")).alias("after"))
    call_id = F.concat(F.lit("c"), key.cast("string"))
    message = lambda turn, role, text: (F.col("c_nationkey").cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    calls = customers.select(*message(key, "assistant", F.to_json(F.struct(F.array(F.struct(call_id.alias("id"), F.lit("rate").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))))
    results = customers.where(key % 3 == 0).select(*message(key + 10**9, "tool", F.to_json(F.struct(call_id.alias("tool_call_id"), F.col("c_name").alias("content")))))
    tools = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey").select(*message(F.lit(-1), "system", F.lit(json.dumps(RATE))))
    return chat_tools.formatted(calls.union(results).union(tools))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    return toxicity.scores(docs, toxicity.train(docs.where("NOT held_out"), labels), ["doc_id", "held_out"]).drop("spans")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_hnsw": op2_hnsw,
    "op3_tool_calls": op3_tool_calls,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_minhash": op6_minhash,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_warc": op9_warc,
    "op10_pii": op10_pii,
    "tool_call_chains": tool_call_chains,
}

ORACLE_SQL: dict[str, str] = {
    # The table's messages are plain content; tool_call_chains has calls, results and schemas.
    "op3_tool_calls": """
        SELECT conv_id, turn, role, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_valid, NULL::INT AS level,
            json_object('content', text, 'role', role)::VARCHAR AS message
        FROM conversations
    """,
    "tool_call_chains": f"""
        WITH RECURSIVE c AS (SELECT c_custkey AS k, c_nationkey AS n, c_name, 'c' || c_custkey AS id, floor(c_acctbal)::BIGINT AS balance, c_mktsegment AS segment FROM customer),
        p AS (SELECT c.*, u.k AS up FROM c LEFT JOIN c u ON u.n = c.n AND u.k = c.k // 2),
        l AS (SELECT k, 0 AS level FROM p WHERE up IS NULL UNION ALL SELECT p.k, l.level + 1 FROM p JOIN l ON p.up = l.k),
        a AS (SELECT p.*, l.level, balance >= 0 AND segment IN ('BUILDING', 'MACHINERY') AS valid, k % 3 = 0 AS linked, json_object('after', '${{c' || k // 2 || '}}', 'balance', balance, 'segment', segment)::VARCHAR AS args FROM p LEFT JOIN l USING (k))
        SELECT n::BIGINT AS conv_id, k AS turn, 'assistant' AS role, 1::BIGINT AS n_calls, linked::BIGINT AS n_linked, valid::BIGINT AS n_valid, level::INT AS level, '{{"role":"assistant","tool_calls":[{{"arguments":' || to_json(args) || ',"id":"' || id || '"'
            || CASE WHEN level IS NULL THEN '' ELSE ',"level":' || level END || ',"name":"rate"' || CASE WHEN linked THEN ',"result":"' || c_name || '"' ELSE '' END || ',"valid":' || valid || '}}]}}' AS message FROM a
        UNION ALL SELECT n, k + 1000000000, 'tool', 0, 1, 0, NULL, json_object('content', c_name, 'name', 'rate', 'role', 'tool', 'tool_call_id', id)::VARCHAR FROM a WHERE linked
        UNION ALL SELECT n_nationkey, -1, 'system', 0, 0, 0, NULL, json_object('content', '{json.dumps(RATE)}', 'role', 'system')::VARCHAR FROM nation
    """,
    "op6_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
        l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
        m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op7_decontamination": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, i, n FROM grams JOIN win USING (n, g)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + any_value(n) AS b FROM (
            SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY i) AS run FROM (
                SELECT h.doc_id, h.item_id, h.i, h.n, h.i - o.o AS d FROM hits h JOIN grams g USING (doc_id, i, n) JOIN (
                    SELECT item_id, o, least(10, len(w)) AS n, array_to_string(w[o:o + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS o FROM bw WHERE len(w) > 0)) o ON o.item_id = h.item_id AND o.n = h.n AND o.g = g.g))
            GROUP BY doc_id, item_id, d, run),
        best AS (SELECT doc_id, max(b - a) AS longest, arg_min(a, (a - 1000000 * (b - a))) AS a FROM runs GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match, (a - 1)::BIGINT AS longest_start
        FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT page_id, n, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i * 5 + 1)::INT, 5))::INT >> (15 - 5 * j)::INT) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS winner FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
        FROM w
    """,
}
