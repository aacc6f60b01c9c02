"""The corpus pipeline: stages over the table documents, each written as Parquet and read again as the next one's docs.

A stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents, also
any more that docs has, whatever their names.  In every stage null and empty texts and null ids are rows like others,
texts are used whole however long, rows that repeat are judged alike, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvello.llm import decontaminate, language_id, neardup, packing, pii
from corvello.llm.common import discard, fold, hidden, materialise, shared_dir, table
from corvello.llm.queries import tokenizer_path
from corvello.storage import scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those with null or empty text or without a letter go.  lang stays as it was.

    Profiles come from the rows of docs whose fold of doc_id (null: of the empty text) is not 2; without any, all rows go.
    """
    langs, profiles = language_id.prototypes(docs.where(fold("doc_id", 4) != 2))
    frame, text, columns = hidden(docs)
    return language_id.identify(frame, langs, profiles, frame.columns, text).where("lang_pred <> 'und'").select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that with the least doc_id (null last; of equal ones any).  Rows without a word are all kept.

    Every row has a key of its own, written once, so rows that repeat a doc_id with other texts are told apart.
    """
    frame, text, columns = hidden(docs)
    rows = materialise(frame.withColumn("__row", F.monotonically_increasing_id()), "rows")
    doc_id = F.col(frame.columns[docs.columns.index("doc_id")])
    base, named = neardup.classes(rows.select(F.col("__row").alias("node"), F.col("__row").alias("doc_id"), F.col(text).alias("text")))
    ids = rows.select(F.col("__row").alias("node"), F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), "__row").alias("place"))
    group = base.join(named.hint("merge"), "digest", "left").select("node", F.coalesce("component_id", "node").alias("group"))
    first = group.join(ids.hint("merge"), "node").groupBy("group").agg(F.min("place").alias("first"))
    kept = materialise(first.select("first.__row"), "kept")
    discard(base, named)
    return rows.join(kept.hint("merge"), "__row", "left_semi").select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; without a benchmark all of them."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars is that of the new text, null for a null one."""
    return pii.masked(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is its end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL can express neither hyperdimensional profiles nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What stages write on the way goes as soon as their result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, before = shared_dir(spark, name), docs
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs.corvello_path = path
        discard(before)
    return docs
