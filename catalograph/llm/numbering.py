"""Numbers for rows, without any sort in one task.

Both functions write their rows once, so that the numbers of tasks stay as they are, and add the counts of earlier tasks: a small
table with a row for each task (and key of that task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

_SHIFT = 33


def number_within(rows: DataFrame, key: str, order: list[Column], run: Scratch, name: str, into: str = "idx") -> DataFrame:
    """rows with `into`, their place in `order` among the rows of `key` from 0, and `n`, the rows of the key.

    Rows are cut into ranges of (key, order); each range is numbered by itself, and the rows of the key in earlier ranges are added. A
    key that holds a third of all rows is spread over a third of the ranges. rows may not have the columns _range and _before.
    """
    cut = rows.repartitionByRange(F.col(key).asc_nulls_first(), *order).withColumn("_range", F.spark_partition_id())
    cut = run.write(cut, name)
    inside = cut.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    counts = cut.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    ranges = Window.partitionBy(key).orderBy("_range")
    before = F.coalesce(F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(key))
    offsets = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), before.alias("_before"), total.alias("n"))
    met = inside.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return met.withColumn(into, (F.col("_before") + F.col("_nth") - 1).cast("long")).drop("_range", "_nth", "_before", "_key", "_at")


def dense_names(keys: DataFrame, run: Scratch, name: str, start: int = 0, into: str = "name") -> tuple[DataFrame, int]:
    """(the distinct rows of keys with a number each, `start` and up without gaps, and the first number that is free).

    The numbers of a task follow those of the tasks before it; the offsets are one row for each task that wrote the table.
    """
    table = run.write(keys.distinct().withColumn("_m", F.monotonically_increasing_id()), name)
    tasks = table.groupBy(F.shiftright("_m", _SHIFT).alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(tasks.select("_task", before.alias("_before")))
    named = table.withColumn("_task", F.shiftright("_m", _SHIFT)).join(offsets, "_task")
    number = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << _SHIFT) - 1)) + F.lit(start)
    return named.select(*keys.columns, number.cast("long").alias(into)), start + table.count()
