"""Files that are made once, in any file system that Spark reads, and numbers that are taken by making them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and its maker of paths."""
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file, whole or not at all; False where it is there already."""
    fs, path_of = file_system(spark, path)
    beside = path_of(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    # renaming never replaces a file in a store that follows HDFS; a local one does, so there a link is made, which doesn't
    if fs.getUri().getScheme() == "file":
        try:
            os.link(beside.toUri().getPath(), path_of(path).toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(beside, False)
    if fs.exists(path_of(path)) or not fs.rename(beside, path_of(path)):
        fs.delete(beside, False)
        return False
    return True


def take_number(spark: SparkSession, folder: str, text: str = "") -> int:
    """The least number above all taken ones, for this caller alone."""
    fs, path_of = file_system(spark, folder)
    fs.mkdirs(path_of(folder))
    while True:
        taken = [int(n) for s in fs.listStatus(path_of(folder)) if (n := s.getPath().getName()).isdigit()]
        number = max(taken, default=-1) + 1
        if create_once(spark, f"{folder}/{number:012d}", text):
            return number
