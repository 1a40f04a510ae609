"""Enrichment derived from processes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import strings


def merge_enrichment(rows: DataFrame) -> DataFrame:
    """rows (id, process_id, capabilities[], use_cases[], groups[], process_next[]) -> one row per id.

    Capabilities and use cases are sorted unions, groups are concatenated by process without removing repeats, and
    processNext is that of the first process that has one.
    """
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(strings(F.col(c))))))
    groups = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("process_id", strings(F.col("groups")).alias("g")))), lambda x: x["g"]))
    first = F.min_by("process_next", F.when(F.size(strings(F.col("process_next"))) > 0, F.col("process_id")))
    return rows.groupBy("id").agg(union("capabilities").alias("capabilities"), union("use_cases").alias("use_cases"), groups.alias("groups"), strings(first).alias("process_next"))


def apply_enrichment(resources: DataFrame, merged: DataFrame) -> DataFrame:
    """Clean resources with the merged fields where there are any."""
    fields = ("capabilities", "use_cases", "groups", "process_next")
    m = merged.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    out = resources.join(m, "id", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*[f"_{c}" for c in fields])
