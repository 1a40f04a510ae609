"""Connected components by alternating large-star and small-star steps, each step a few DataFrame joins.

Edges are (u, v) longs. No step gathers a neighbourhood: minima are partial aggregates, and the join of a hub's
edges to its minimum is a sort-merge join that AQE may split. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _down(df: DataFrame) -> DataFrame:
    """Edges from the greater to the smaller end, once each, without loops."""
    return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge: root is the least node of its component."""
    run = Scratch(edges.sparkSession, tag)
    now = run.write(_down(edges.select("u", "v")), "0")
    mark = None
    for r in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = run.write(_down(small), str(r))
        run.delete(str(r - 1))
        was, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
