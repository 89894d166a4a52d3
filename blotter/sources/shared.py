"""Folders that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: what ``spark.checkpoint.dir`` names, or what the caller
    gave to ``setCheckpointDir``. None is made up, as it would be local to one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing path in the shared folder, dropped when Spark ends."""
    parent = f"{shared_root(spark)}/blotter-{spark.sparkContext.applicationId}"
    path, files = _place(spark, parent)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{parent}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder made below the shared one, with all in it, if it is there."""
    if not folder.startswith(f"{shared_root(spark)}/"):
        raise ValueError(f"{folder} is not in the shared folder")
    path, files = _place(spark, folder)
    files.delete(path, True)


def _place(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
