"""What several corpus operators share: reading tables, the shared folder, hashes of ids."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line contracts, as a Java character class and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the folder `sf_dir`, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'catalograph-shared')}"


#: Shuffle files of a write go when it ends: the table holds what they led to.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """The intermediate tables of one run, in a folder of their own below the shared one.

    write() cuts the lineage with Parquet files that outlive any executor; delete() removes tables that nothing reads any more. What
    a result still reads stays until the shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/catalograph/{tag}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df written as table `name` and read back."""
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(f"{self.path}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN)
            else:
                self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def delete(self, *names: str) -> None:
        """Delete tables by name."""
        for name in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() agrees with that on pure ASCII and has a fast path for it; other texts go through translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    """The cluster's own number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(columns: list[str], base: str) -> str:
    """`base`, with underscores in front until no column has that name."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def id_text_crc(doc_id: Column) -> Column:
    """crc32 of an id as text, the fold key of the learning operators."""
    return F.crc32(doc_id.cast("string").cast("binary"))
