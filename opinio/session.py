"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows that hold a block of vectors or a long text: a batch is bounded by bytes too.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Fallback work folder, used only where the session names none (local runs, tests).
_LOCAL_WORK_DIR: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    # Python workers import this package by name from where the driver has it, unless it
    # is installed.
    known = spark.sparkContext.environment
    if PACKAGE_ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [PACKAGE_ROOT, known.get("PYTHONPATH", "")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local session without ``spark.checkpoint.dir`` gets a folder of its own.
    """
    global _LOCAL_WORK_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _LOCAL_WORK_DIR is None:
        _LOCAL_WORK_DIR = tempfile.mkdtemp(prefix="opinio-")
    return _LOCAL_WORK_DIR


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Cache with spill to disk; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def kept(df: DataFrame) -> bool:
    """Whether a frame is cached."""
    level = df.storageLevel
    return level.useMemory or level.useDisk


def keep_texts(df: DataFrame) -> DataFrame:
    """Cache on disk alone: texts that are read a few times take no memory from the work on them."""
    return df.persist(StorageLevel.DISK_ONLY)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small scan.

    A scan with as many partitions as cores, which any large one has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
