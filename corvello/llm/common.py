"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvello.storage import discard, materialise, shared_dir

__all__ = ["ARROW_BYTES", "bound_batches", "bounded", "discard", "fold", "hidden", "hot_limit", "kinds", "materialise", "shared_dir", "table", "with_text"]

#: Bytes of an Arrow batch of texts, unless the session has a limit of its own.
ARROW_BYTES = 4 << 20

#: Keys with more than one of HOT_SHARE rows are hot; there are fewer than HOT_SHARE of them, whatever the input's size.
HOT_SHARE = 500


def hot_limit(rows: DataFrame, least: int) -> int:
    """Rows of a key above which it counts as hot, at least ``least``; counts ``rows``, which should be a written table."""
    return max(least, -(-rows.count() // HOT_SHARE))


def bounded(keys: DataFrame) -> DataFrame:
    """Keys that are fewer than HOT_SHARE by the choice of hot_limit, for a broadcast."""
    return F.broadcast(keys)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold ARROW_BYTES at most, for texts differ in length by orders of magnitude."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(limit):
        spark.conf.set(limit, str(ARROW_BYTES))


def with_text(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, int]:
    """Columns ``keep`` for a mapInArrow in bounded batches, and the number of the text's column, which comes last unless it is one of them."""
    bound_batches(docs.sparkSession)
    columns = keep if text in keep else [*keep, text]
    return docs.select(*(F.col(f"`{c}`") for c in columns)), columns.index(text)


def kinds(frame: DataFrame, names: list[str]) -> list[str]:
    """Columns and their types as in a schema's text."""
    return [f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in names]


def hidden(docs: DataFrame) -> tuple[DataFrame, str, list]:
    """``docs`` with names that clash with nothing, that of the text's column, and the columns that restore it."""
    names = [f"__{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")], [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
