"""Session helpers: local sessions for tests/bench and cluster-side settings."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Settings every session should have; sized per deployment by the caller.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # checkpoints written by the ranking operators are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Starting point for a large cluster (~1000 executors, ~100 TB of transactions).
# AQE coalesces the many initial shuffle partitions down to ~256 MB each and
# splits skewed join partitions; auto-broadcast stays at its default and is only
# applied by AQE after the real (post-shuffle) size of a side is known.
CLUSTER_CONF = {
    **BASE_CONF,
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "ledgerlens", driver_memory: str | None = None) -> SparkSession:
    """A ``local[cores]`` session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cores)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir; set a scratch one only in a local session without one.

    On a cluster ``spark.checkpoint.dir`` names a shared, reliable folder and is
    used as is; without it a cluster session is an error, because executors would
    write to disks that the others cannot see.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    target = configured or tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table under the checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerlens/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` evaluated once into the shared checkpoint folder (its files go when nothing refers to them), and its number of rows."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    kept = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint()
    return kept, seen.get["rows"]


@contextmanager
def materialized(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` written once under the shared checkpoint dir and read again; the files go when the block ends."""
    spark = df.sparkSession
    path = scratch_path(spark, "scratch")
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

