"""Which typed fields lead to a resource, and who shares them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sorted_overlap, strings

FIELDS = {"capabilities": "capabilities", "entityTypes": "entity_types", "partOfGroups": "groups", "lineOfBusiness": "line_of_business"}


def structural_solvability(resources: DataFrame, first: int = 3) -> DataFrame:
    """(seq, field, n_sharing, sharing): others that share a value of the field, and the first few by seq."""
    values = F.concat(*[F.transform(F.array_distinct(strings(F.col(c))), _named(f)) for f, c in FIELDS.items()])
    long = resources.select("seq", F.explode(values).alias("x")).select("seq", "x.field", "x.value")
    other = long.withColumnRenamed("seq", "other")
    met = long.join(other, ["field", "value"]).filter("seq <> other").select("seq", "field", "other").distinct()
    nth = met.withColumn("n", F.row_number().over(Window.partitionBy("seq", "field").orderBy("other")))
    shared = nth.groupBy("seq", "field").agg(F.count(F.lit(1)).alias("n_sharing"), F.array_sort(F.collect_list(F.when(F.col("n") <= first, F.col("other")))).alias("sharing"))
    every = resources.select("seq", F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field"))
    return every.join(shared, ["seq", "field"], "left").select("seq", "field", F.coalesce("n_sharing", F.lit(0)).cast("long").alias("n_sharing"), F.coalesce("sharing", F.array().cast("array<long>")).alias("sharing"))


def _named(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))


def method_paths(resources: DataFrame) -> DataFrame:
    """(seq, method_b, method_c, method_d, solvable)."""
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return resources.select("seq", has("entity_types").alias("method_b"), (has("entity_types") | has("groups")).alias("method_c"), has("capabilities").alias("method_d"), (has("capabilities") | has("entity_types") | has("groups")).alias("solvable"))


def overlaps(pairs: DataFrame, resources: DataFrame) -> DataFrame:
    """pairs (seq_a, seq_b) with their shared capabilities and lines of business."""
    side = lambda s: resources.select(F.col("seq").alias(f"seq_{s}"), F.col("capabilities").alias(f"c{s}"), F.col("line_of_business").alias(f"l{s}"))
    j = pairs.select("seq_a", "seq_b").join(side("a"), "seq_a").join(side("b"), "seq_b")
    return j.select("seq_a", "seq_b", sorted_overlap(F.col("ca"), F.col("cb")).alias("capability_overlap"), sorted_overlap(F.col("la"), F.col("lb")).alias("domain_overlap"))
