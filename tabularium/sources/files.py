"""Folders on shared storage, through the file system Spark itself uses."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_LOCAL = "^file:/+"


def _open(spark: SparkSession, path: str):
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle, handle.getFileSystem(spark._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if there is no folder."""
    handle, fs = _open(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(handle)] if fs.exists(handle) else []


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote this folder has committed."""
    handle, fs = _open(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(handle))


def delete(spark: SparkSession, path: str) -> None:
    handle, fs = _open(spark, path)
    fs.delete(handle, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of everything below a folder."""
    handle, fs = _open(spark, path)
    return int(fs.getContentSummary(handle).getLength())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as ``plain_uri`` gives those that Spark's readers tell in their metadata column."""
    handle, fs = _open(spark, path)
    return re.sub(_LOCAL, "file:/", fs.makeQualified(handle).toUri().toString())


def plain_uri(uri: Column) -> Column:
    """Local files are told with one or three slashes; here always with one."""
    return F.regexp_replace(uri, _LOCAL, "file:/")
