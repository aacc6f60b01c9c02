"""Tables in the folder that all executors share: cuts of the lineage that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratches: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a folder of this machine is set if driver and executors are one process; else that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvello-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _scratches:
        made.append(path)
    return path


#: Bytes of a file of a slim table.
FILE_BYTES = 16 << 20


def materialise(df: DataFrame, name: str, rows: int | None = None, width: int = 32) -> DataFrame:
    """Write a frame below the shared folder and read it again.

    rows: the most that it can have, of about ``width`` bytes each, also counting what the tasks that write them read.  A
    table that is small for its number of shuffle partitions is then written by as few tasks as its size needs; else every
    partition leaves a file or two.
    """
    path = shared_dir(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows * width // FILE_BYTES)))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.corvello_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame | None) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "corvello_path", None):
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete all that is written below the shared folder inside the block; frames that read it are of no use after it.

    Operators return frames that read tables of theirs, so what they wrote can go only when the result is stored:

        with scratch(spark):
            operator(docs).write.parquet(target)
    """
    made: list[str] = []
    _scratches.append(made)
    try:
        yield
    finally:
        _scratches.remove(made)
        for path in made:
            _delete(spark, path)
