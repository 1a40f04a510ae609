"""Rollups over the generation log (phase, action, outcome, round, judge_verdict) and over test-case logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def generation_rounds(log: DataFrame, seeds: int | DataFrame = 0) -> DataFrame:
    """(round, generated, accepted) of create events; seeds are round 0."""
    created = log.filter((F.col("phase") == "iterative") & (F.col("action") == "create"))
    rounds = created.groupBy("round").agg(F.count(F.lit(1)).alias("generated"), F.count_if(F.col("outcome") == "accepted").alias("accepted"))
    if isinstance(seeds, int):
        zero = log.sparkSession.range(1).select(F.lit(0).alias("round"), F.lit(seeds).cast("long").alias("generated"), F.lit(seeds).cast("long").alias("accepted"))
    else:
        zero = seeds.agg(F.count(F.lit(1)).alias("generated")).select(F.lit(0).alias("round"), "generated", F.col("generated").alias("accepted"))
    return rounds.unionByName(zero.withColumn("round", F.col("round").cast(rounds.schema["round"].dataType)))


def cumulative(rounds: DataFrame) -> DataFrame:
    """Rounds with the running number of accepted resources."""
    return rounds.withColumn("cumulative", F.sum("accepted").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))


def gap_reach(log: DataFrame) -> DataFrame:
    """(round, created, skipped, reach_pct): share of gaps that led to a candidate."""
    it = log.filter(F.col("phase") == "iterative")
    create, skip = F.col("action") == "create", (F.col("action") == "skip") & (F.col("outcome") == "no_profile")
    out = it.filter(create | skip).groupBy("round").agg(F.count_if(create).alias("created"), F.count_if(skip).alias("skipped"))
    return out.withColumn("reach_pct", F.round(100.0 * F.col("created") / (F.col("created") + F.col("skipped")), 1))


def gate_stats(log: DataFrame, flags: dict[str, str] = {"incoherent": "c2_coherent", "duplicate": "c3_not_duplicate", "entity_types": "c4_et_justified"}) -> DataFrame:  # noqa: B006
    """One row: attempts, verdicts, acceptance rate, and how often each criterion was false (null is not false)."""
    it = log.filter(F.col("phase") == "iterative")
    is_ = lambda o: F.col("outcome") == o
    accepted, rejected = F.count_if(is_("accepted")), F.count_if(is_("rejected_judge"))
    reasons = [F.count_if(is_("rejected_judge") & (F.col("judge_verdict")[key] == F.lit(False))).alias(name) for name, key in flags.items()]
    return it.agg(
        F.count_if(F.col("action") == "create").alias("created"),
        (accepted + rejected).alias("reached_judge"),
        accepted.alias("accepted"),
        rejected.alias("rejected_judge"),
        F.round(F.coalesce(F.try_divide(100.0 * accepted, accepted + rejected), F.lit(0.0)), 1).alias("acceptance_rate"),
        *reasons,
        F.count_if(is_("wrong_tier")).alias("wrong_tier"),
        F.count_if(is_("rejected_c1")).alias("rejected_c1"),
    )


def outcome_counts(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("n"))


def attempts(log: DataFrame, process: str = "process_id") -> DataFrame:
    """One row: processes, attempts, processes with several attempts, most attempts."""
    per = log.groupBy(process).agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("processes"), F.sum("k").alias("attempts"), F.count_if(F.col("k") > 1).alias("multi_attempt"), F.max("k").alias("most"))


def evolution_outcomes(provenance: DataFrame) -> DataFrame:
    """(prefix, outcome, n) of nested evolution logs by the prefix of case_id."""
    rows = provenance.select(F.substring_index("case_id", "-", 1).alias("prefix"), F.explode("evolution_log").alias("e"))
    return rows.groupBy("prefix", F.col("e.outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def iteration_stats(cases: DataFrame) -> DataFrame:
    """Iterations by mode from the size of the log; a missing log counts as one."""
    n = F.when(F.coalesce(F.size("evolution_log"), F.lit(0)) > 0, F.size("evolution_log")).otherwise(1)
    return cases.groupBy("mode").agg(F.count(F.lit(1)).alias("cases"), F.sum(n).cast("long").alias("iterations"), F.round(100.0 * F.count_if(n == 1) / F.count(F.lit(1)), 1).alias("one_shot_pct"))


def survivors_by_round(accepted: DataFrame, final: DataFrame) -> DataFrame:
    """Accepted ids (id, round, position) that are still in the catalogue, numbered in order of acceptance."""
    kept = accepted.join(final.select("id"), "id", "left_semi")
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("round").orderBy("position")))


def last_prompts(attempts_: DataFrame) -> DataFrame:
    """For each case: number of attempts and the last prompt that is not null."""
    last = F.max_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("attempt")))
    return attempts_.groupBy("case_id").agg(F.max("attempt").alias("attempts"), last.alias("prompt"))
