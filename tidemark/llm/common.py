"""What several corpus operators share: reading tables, writing intermediate
tables to the cluster's shared folder, and sizing groups."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case and its lower case; other letters keep their case.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: A run of characters that are not ASCII white space is a word.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (as in tests) may leave it unset and gets a temporary
    one; on a cluster such a folder would be another one on each machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark then removes a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps then start from files that any executor can read, so a lost
    executor costs the tasks that ran on it and no recomputation of ``df``, and
    the shuffle files that led to ``df`` are of no more use and are removed.
    ``options`` are those of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextlib.contextmanager
def large_rows(spark: SparkSession):
    """While this holds, tasks take rows one by one, as suits tables whose rows hold megabytes."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "1")
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextlib.contextmanager
def batches_of(spark: SparkSession, n_bytes: int):
    """While this holds, tasks take rows in batches of about so many bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n_bytes)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for df in written:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z and nothing else; null becomes the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.translate(F.coalesce(col, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def words_of(col: Column | str) -> Column:
    """The words of a text (runs of non-space characters), lower-cased in ASCII."""
    return F.filter(F.split(ascii_lower(col), SPACES), lambda w: w != "")


def groups_for(rows: int, per_group: int) -> int:
    """How many hash groups hold about ``per_group`` of ``rows`` rows each."""
    return max(1, -(-rows // per_group))
