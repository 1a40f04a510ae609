"""Session defaults: adaptive execution, UTC, ANSI."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; options of a running session stay as they are."""
    builder = SparkSession.builder.appName("catalograph")
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for an application: they may start in a folder without it."""
    here = Path(__file__).parent
    name = f"catalograph-{spark.sparkContext.applicationId}.zip"
    if any(f.endswith(name) for f in spark.sparkContext.listFiles):
        return
    path = Path(tempfile.mkdtemp()) / name
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(path))


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'catalograph-shared')}"
    return f"{root.rstrip('/')}/catalograph/{tag}-{uuid.uuid4().hex}"


#: Shuffle files of a write go when it ends: the table holds what they led to.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """df written to a path and read back; its shuffle files are deleted."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of its own in the shared folder: computed once, read as often as needed, whatever executors are lost."""
    return put(df, shared_folder(df.sparkSession, tag))


#: Rows up to which a table may meet every row of another one.
SMALL = 100_000


def few(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df for a join that every row of the other side meets whole: an error beyond `most` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows can't meet every row of another table")
    return F.broadcast(df)
