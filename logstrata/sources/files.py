"""Folder operations through Spark's own file system layer.

They work on whatever storage the table folder is on. Only the driver calls
them, on folders, never per row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _fs(spark, path)
    return fs.exists(jvm_path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    fs, jvm_path = _fs(spark, pattern)
    found = fs.globStatus(jvm_path)
    return [] if found is None else [status.getPath().toString() for status in found]


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder."""
    fs, jvm_path = _fs(spark, path)
    return fs.getContentSummary(jvm_path).getLength()


def delete(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _fs(spark, path)
    fs.delete(jvm_path, True)


def create(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, jvm_path = _fs(spark, path)
    fs.create(jvm_path, True).close()


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate tables.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``;
    only on one machine, and where that is unset, in a local temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return tempfile.mkdtemp(prefix="run-")
