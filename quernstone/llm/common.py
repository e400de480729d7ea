"""Shared helpers: intermediate tables in the cluster's shared folder, column naming, text kinds."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define words.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent in a local session (as in tests) a temporary
    folder of this process is used and kept for the session.  On a cluster its
    absence is an error: executors would write to folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir isn't set, and executors of {master} share no other folder with the driver")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder, in this session's part of it, that no other run uses."""
    return f"{shared_dir(spark)}/quernstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage with files every executor can read, so a lost executor
    costs a reread and not the whole plan.  ``drop`` deletes the files.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more; other frames are passed over."""
    for df in frames:
        if path := _paths.pop(df, None):
            remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this session's operators have stored, once their results have been read."""
    remove(spark, f"{shared_dir(spark)}/quernstone/{spark.sparkContext.applicationId}")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone; other alphabets stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_bucket(col: str, mod: int) -> Column:
    """crc32 of a key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod
