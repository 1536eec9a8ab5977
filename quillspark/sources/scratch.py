"""Folders for what a query writes and reads again, on storage that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` or the context's, removed when the process ends; a temporary one only where all runs on one machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = sc._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="quillspark-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def file_system(spark: SparkSession, path: str) -> tuple:
    """The path as the storage's own, and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        found, system = file_system(spark, path)
        system.delete(found, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass
