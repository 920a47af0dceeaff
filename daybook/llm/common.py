"""Shared helpers: input tables, shared-folder staging, the train / held-out split."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). Only a local session may go without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="daybook-llm-")
    return _local_dirs[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage is cut, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 by three. A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(3)) == 1, F.lit(False))


def text_key(text: str | Column = "text") -> Column:
    """128 bits that stand for a whole text; null and the empty text share one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(c, F.lit(""))))


def partitions_for(spark: SparkSession, input_bytes: int, per_partition: int) -> int:
    """Number of partitions in proportion to the input, never below the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // per_partition), 1)
