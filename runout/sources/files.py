"""Small files in the store that Spark uses: list, read, create once, remove."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    store, at = _opened(spark, folder)
    try:
        return [status.getPath().getName() for status in store.listStatus(at)]
    except Py4JJavaError as e:
        if "java.io.FileNotFoundException" in str(e.java_exception.toString()):
            return []
        raise


def content(spark: SparkSession, path: str) -> str:
    store, at = _opened(spark, path)
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content, or return False if it exists.

    The content is written beside it and renamed, which stores refuse if the name is taken. Local renames
    replace files, so a local file gets its name as a hard link.
    """
    store, at = _opened(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    stream = store.create(beside, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    try:
        if store.getUri().getScheme() != "file":
            return store.rename(beside, at)
        os.link(beside.toUri().getPath(), at.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        store.delete(beside, False)


def remove(spark: SparkSession, path: str) -> None:
    store, at = _opened(spark, path)
    store.delete(at, True)
