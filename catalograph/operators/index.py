"""A stored TF-IDF index by version: what a change brings or takes away is counted, the rest stays as it is.

A version has the term counts of each text (counts) and the number of texts of each term (df). Weights follow from both when they are
read, so they are those of an index built anew, whatever the order of the changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources import snapshots
from .features import normalised, term_counts, weighted

COUNTS, DF = "seq long, length long, terms array<string>, counts array<long>", "term string, df long"


def _terms(counts: DataFrame, sign: int = 1) -> DataFrame:
    return counts.select(F.explode("terms").alias("term"), F.lit(sign).cast("long").alias("df"))


def _summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")


def _commit(spark: SparkSession, root: str, base: int, counts: DataFrame, df: DataFrame) -> bool:
    def write(at: str) -> None:
        counts.write.parquet(f"{at}/counts")
        df.write.parquet(f"{at}/df")

    return snapshots.commit(spark, root, base, write)


def build(resources: DataFrame, root: str, text: str = "text") -> int:
    """Version 0, of resources (seq, text); an index that is there already is an error."""
    counts = written(term_counts(resources.select("seq", text).repartition("seq"), text), "counts")
    if not _commit(resources.sparkSession, root, -1, counts, _summed(_terms(counts))):
        raise ValueError(f"{root} has an index")
    return 0


def update(root: str, put: DataFrame, gone: DataFrame, text: str = "text", tries: int = 5) -> int:
    """The next version: texts of `put` (seq, text) added or replaced, those of `gone` (seq) taken out unless put; its number.

    Only these texts are counted, and only their terms change df; unknown ones of `gone` are passed over. A lost race is tried again.
    """
    spark = put.sparkSession
    fresh = written(term_counts(put.select("seq", text).repartition("seq"), text), "counts")
    touched = fresh.select("seq").unionByName(gone.select(F.col("seq").cast("long"))).distinct()
    for _ in range(tries):
        base = snapshots.latest(spark, root)
        counts, df = tables(spark, root, base)
        old = counts.join(touched, "seq", "left_semi")
        changed = _summed(df.unionByName(_terms(old, -1)).unionByName(_terms(fresh)))
        if _commit(spark, root, base, counts.join(touched, "seq", "left_anti").unionByName(fresh), changed):
            return base + 1
    raise RuntimeError(f"{tries} updates of {root} were overtaken by others")


def tables(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, df) of a version, the last one if none is named."""
    at = snapshots.at_version(root, snapshots.latest(spark, root) if version is None else version)
    return spark.read.schema(COUNTS).parquet(f"{at}/counts"), spark.read.schema(DF).parquet(f"{at}/df")


def weights(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(seq, term, tf, idf, weight), as features.tfidf() of the texts of this version."""
    counts, df = tables(spark, root, version)
    return weighted(counts, counts.agg(F.count(F.lit(1)).alias("n_docs")), df)


def vectors(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(seq, terms, weights), as features.text_vectors(): the `texts` of the block kernels."""
    return normalised(weights(spark, root, version))
