"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession

# Semantics, not tuning: results depend on these.
REQUIRED_CONF = {
    # Naive timestamps are UTC and every stored timestamp is UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of failing the record.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Plan defaults: sizes are decided at run time from measured shuffle output.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session and return it."""
    for key, value in {**REQUIRED_CONF, **PLAN_CONF}.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode and only when the setting is absent; on a cluster
    the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="wardwatch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table written by one run."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class SharedFile(NamedTuple):
    path: str
    modified: int


def shared_files(spark: SparkSession, pattern: str) -> list[SharedFile]:
    """Files and folders that match a pattern, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [SharedFile(f.getPath().toString(), f.getModificationTime()) for f in found or []]
