"""Our extension: the generation log as a stream. Rollups over files as they arrive, with watermarks for late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import LOG_EVENT


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_EVENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).withColumn("ts", F.to_timestamp("timestamp"))


def round_counts(events: DataFrame) -> DataFrame:
    """(round, generated, accepted, skipped): complete or update mode; state is one row per round."""
    it = events.filter("phase = 'iterative'")
    created = F.col("action") == "create"
    return it.groupBy("round").agg(F.count_if(created).alias("generated"), F.count_if(created & (F.col("outcome") == "accepted")).alias("accepted"), F.count_if(F.col("action") == "skip").alias("skipped"))


def outcome_windows(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes", time: str = "ts") -> DataFrame:
    """(window, outcome, n): append mode once the watermark has passed a window."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "outcome").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "outcome", "n")


def maintain(events: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to update(batch, id), for tier counts kept up with the log (changed_pairs does the scoring)."""
    return events.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).start()
