"""Session helper for local runs and tests. On a cluster, pass your own session."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("daybook")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Joins on voucher keys: hash rather than sort when a shuffled partition is small enough.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.driver.memory", os.environ.get("DAYBOOK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    fallback = tempfile.mkdtemp(prefix="daybook-ckpt-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted when its action ends; otherwise they stay until the driver collects its plan.

    For actions whose result is in files or on the driver, so that nothing reads those shuffles again.
    """
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def written_down(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: few tasks for few rows, no lineage, and a lost executor costs a re-read.

    The shuffles that made it are released, so a job in steps holds those of one step.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/daybook-{name}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
