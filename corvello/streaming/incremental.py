"""Incremental corpora: pages that arrive as files are indexed once each and appended to the postings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corvello.operators import fulltext


def index_new_pages(spark: SparkSession, source: str, schema: StructType, doc: str, html: str, target: str, checkpoint: str) -> StreamingQuery:
    """Start a query that indexes Parquet files of pages as they appear below ``source`` and ends when all are done.

    A batch is written below its own number, so one that runs again after a failure replaces what it wrote before.
    """

    def append(batch: DataFrame, number: int) -> None:
        words = fulltext.words(fulltext.runs(batch, doc, html))
        fulltext.postings(words).write.mode("overwrite").parquet(f"{target}/batch={number}")

    pages = spark.readStream.schema(schema).parquet(source)
    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_postings(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")
