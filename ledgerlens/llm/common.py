"""Shared pieces of the training-data operators: tables, words, shared files."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.session import ensure_checkpoint_dir

# A word: code points other than space and U+0009..U+000D. The same class for Python's re and for Java.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)


# rows of whole texts that cross to Python at once (Spark's default is 10,000)
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches were bounded to ``BATCH_ROWS`` rows: texts are long, and a task's memory,
    in the JVM and in Python, holds a batch. The setting stays, because plans read it when they run."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, null and empty: 0. Stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder (reliable: survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder under the session's shared checkpoint folder, for files that tasks write."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if base.startswith("/"):
        base = f"file://{base}"
    elif base.startswith("file:/") and not base.startswith("file://"):
        base = f"file://{base[len('file:'):]}"
    return f"{base}/llm/{name}-{uuid.uuid4().hex[:12]}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a URI (file, s3, gs, hdfs)."""
    return pafs.FileSystem.from_uri(uri)


def write_once(uri: str):
    """Open ``uri`` for writing inside a task; the caller names files by attempt, so no two attempts share one."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    # by default a name that ends in .zst would be compressed once more
    return fs.open_output_stream(path, compression=None)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row per key) where a few keys may hold most rows.

    The ``hot`` largest groups by ``size`` are broadcast (at most ``hot`` rows). Every other group has at most
    1/hot of all rows, so the shuffle join that serves them has no hot key; rows already served travel through
    it under a key of their own each (partition and place), so equal rows are spread too. ``rows`` should come from a scan or a
    checkpoint, whose order a repeated task meets again. Columns of ``groups`` other than ``key`` are added, null
    where there is no group. Null keys join nothing.
    """
    values = [c for c in groups.columns if c != key]
    top = groups.orderBy(F.desc(size), key).limit(hot).select(F.col(key).alias("hot_key"), F.struct(*values).alias("hot_value"))
    cold = groups.select(F.col(key).cast("string").alias("cold_key"), F.struct(*values).alias("cold_value"))
    # no key's text begins with '#'
    own = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    probe = F.when(F.col("hot_value").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(own)
    out = rows.join(F.broadcast(top), F.col(key) == F.col("hot_key"), "left").withColumn("probe", probe)
    out = out.join(cold, F.col("probe") == F.col("cold_key"), "left").withColumn("value", F.coalesce("hot_value", "cold_value"))
    return out.select(*rows.columns, *[F.col("value")[c].alias(c) for c in values])
