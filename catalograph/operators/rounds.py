"""Near-duplicate reduction in its own order, many pairs at once.

The loop takes the pairs from the most similar on, drops one end of each pair whose ends are both there, and looks at the HIGH
neighbours that the ends still have. What a pair does depends only on earlier pairs at its ends and at their HIGH neighbours. So a
round decides every pair whose ends no earlier open pair may remove and whose neighbours cannot change its answer any more:
those that are safe for it (no earlier pair may remove them, not removed before it) already suffice, or all that may remain do not. A pair
may remove its B, and its A unless it is sure from the start to drop B: A has too few HIGH neighbours at all, or B enough that are in no pair. So
copies of one resource all go in one round. The first open pair of all always qualifies, so rounds end; the result is that of the loop, pair by
pair.

Scores are those of the catalogue as it is at the start; drivers.reduce_in_order counts rarities anew after each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NEAR_DUPLICATE, TIER_MINIMUM
from ..session import written
from .reduction import HIGH


def reduce_in_rounds(pairs: DataFrame, need: int = TIER_MINIMUM["high"], most: int = 10_000) -> tuple[DataFrame, int]:
    """((seq_a, seq_b, sim, action, round) of the decided pairs, rounds): drop_a where only A keeps `need` HIGH neighbours, else drop_b. pairs: (seq_a, seq_b, sim) from HIGH on."""
    pairs = written(pairs.filter(F.col("sim") >= HIGH).select("seq_a", "seq_b", "sim"), "pairs")
    high = pairs.filter(F.col("sim") < NEAR_DUPLICATE)
    near = high.select(F.col("seq_a").alias("end"), F.col("seq_b").alias("other")).unionByName(high.select(F.col("seq_b").alias("end"), F.col("seq_a").alias("other")))
    open_ = pairs.filter(F.col("sim") >= NEAR_DUPLICATE).select(F.struct((-F.col("sim")).alias("s"), "seq_a", "seq_b").alias("o"))
    paired = open_.select(F.explode(F.array("o.seq_a", "o.seq_b")).alias("other")).distinct().withColumn("paired", F.lit(True))
    known = near.join(paired, "other", "left").groupBy("end").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("paired").isNull()).alias("kept"))
    side = lambda c: known.select(F.col("end").alias(f"_{c}"), F.col("all" if c == "a" else "kept").alias(f"n_{c}"))
    open_ = open_.join(side("a"), F.col("o.seq_a") == F.col("_a"), "left").join(side("b"), F.col("o.seq_b") == F.col("_b"), "left")
    open_ = written(open_.select("o", ((F.coalesce("n_a", F.lit(0)) < need) | (F.coalesce("n_b", F.lit(0)) >= need)).alias("sure")), "open")
    gone = None
    decided: list[DataFrame] = []
    for nth in range(most):
        if open_.isEmpty():
            break
        ends = open_.select("o", F.explode(F.when(F.col("sure"), F.array("o.seq_b")).otherwise(F.array("o.seq_a", "o.seq_b"))).alias("end"))
        first = written(ends.groupBy("end").agg(F.min("o").alias("first")), "first")
        at = lambda c: first.select(F.col("end").alias(c), F.col("first").alias(f"_{c}"))
        turn = open_.select("o", F.col("o.seq_a").alias("a"), F.col("o.seq_b").alias("b")).join(at("a"), "a", "left").join(at("b"), "b").filter("o = _b AND (_a IS NULL OR _a >= o)").select("o")
        # The HIGH neighbours of both ends, as they are when the pair has its turn.
        asked = turn.select("o", F.explode(F.array("o.seq_a", "o.seq_b")).alias("end")).join(near, "end").join(first.withColumnRenamed("end", "other"), "other", "left")
        asked = asked.join(gone.select(F.col("seq").alias("other"), "when"), "other", "left") if gone is not None else asked.withColumn("when", F.lit(None).cast(open_.schema["o"].dataType))
        there = F.col("when").isNull() | (F.col("when") > F.col("o"))
        may_go = F.col("first") < F.col("o")
        side = F.col("end") == F.col("o.seq_b")
        count = lambda c: F.count_if(there & c)
        safe = F.coalesce(~may_go, F.lit(True))
        counts = asked.groupBy("o").agg(count(side & safe).alias("b0"), count(side).alias("b1"), count(~side & safe).alias("a0"), count(~side).alias("a1"))
        known = turn.join(counts, "o", "left").fillna(0, ["a0", "a1", "b0", "b1"])
        action = F.when((F.col("b0") >= need) | (F.col("a1") < need), "drop_b").when((F.col("b1") < need) & (F.col("a0") >= need), "drop_a")
        now = written(known.select("o", action.alias("action")).filter("action IS NOT NULL").withColumn("round", F.lit(nth)), "decided")
        decided.append(now)
        dropped = now.select(F.when(F.col("action") == "drop_a", F.col("o.seq_a")).otherwise(F.col("o.seq_b")).alias("seq"), F.col("o").alias("when"))
        gone = written(dropped if gone is None else gone.unionByName(dropped), "gone")
        # What is decided, or lost an end before its turn, is no longer open.
        left = open_.select("o", "sure", F.col("o.seq_a").alias("a"), F.col("o.seq_b").alias("b"))
        for c in "ab":
            left = left.join(dropped.select(F.col("seq").alias(f"_{c}"), "when"), (F.col(c) == F.col(f"_{c}")) & (F.col("when") <= F.col("o")), "left_anti")
        open_ = written(left.select("o", "sure"), "open")
    else:
        raise RuntimeError(f"pairs are open after {most} rounds")
    if not decided:
        return pairs.filter("false").withColumns({"action": F.lit(""), "round": F.lit(0)}), 0
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("o.seq_a", "o.seq_b", (-F.col("o.s")).alias("sim"), "action", "round"), len(decided)
