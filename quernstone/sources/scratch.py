"""Intermediate tables in the folder that the cluster's executors and driver share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """This session's part of ``spark.checkpoint.dir``.

    Where that is unset, a local session has a temporary folder; on a cluster it
    is an error, as executors would write to folders of their own.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return f"{found.rstrip('/')}/quernstone/{spark.sparkContext.applicationId}"
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir isn't set, and executors of {master} share no other folder with the driver")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return _own[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again, which cuts its lineage with files that outlive an executor."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more; other frames are passed over."""
    for df in frames:
        if path := _paths.pop(df, None):
            _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this session has stored, once its results have been read."""
    _remove(spark, folder(spark))
