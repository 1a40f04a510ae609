"""Tables by version: a change is written beside the versions and becomes the next one by a rename, or is lost to who was first.

A version is a folder root/v<number>; what is in it never changes, so a reader that has a number keeps what it saw. The rename fails where
the version exists. It is atomic on HDFS; where a file system checks and renames in two steps, as the local one, two writers
must not commit at the same instant.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, at: str):
    return spark._jvm.org.apache.hadoop.fs.Path(at)


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version; -1 where there is none."""
    fs = _files(spark, root)
    if not fs.exists(_path(spark, root)):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, root))]
    return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()), default=-1)


def at_version(root: str, version: int) -> str:
    return f"{root}/v{version}"


def commit(spark: SparkSession, root: str, base: int, write: Callable[[str], None]) -> bool:
    """What write() puts into a folder becomes version base + 1. False, and nothing has changed, where another writer made that version."""
    new = f"{root}/_new-{uuid.uuid4().hex}"
    write(new)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(_path(spark, new).toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(_path(spark, new), _path(spark, at_version(root, base + 1)), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        _files(spark, root).delete(_path(spark, new), True)
        return False
    return True


def read(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The table of a version, the last one if none is named; empty where there is none."""
    version = latest(spark, root) if version is None else version
    return spark.createDataFrame([], schema) if version < 0 else spark.read.schema(schema).parquet(at_version(root, version))


def change(spark: SparkSession, root: str, schema, step: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """step() of the last version becomes the next one; its number. A lost race is tried again on what the winner wrote."""
    for _ in range(tries):
        base = latest(spark, root)
        now = step(read(spark, root, schema, base))
        if commit(spark, root, base, lambda at: now.write.parquet(at)):
            return base + 1
    raise RuntimeError(f"{tries} changes of {root} were overtaken by others")
