"""Certification: many runs of each case, classified by how often the baseline solves it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected_ids(mode: Column, gaps: Column, fallback: Column) -> Column:
    """Expected ids of a case by its mode: all gaps for SA, the first for SG and DY, else the fallback."""
    return F.when(mode == "SA", gaps).when(mode.isin("SG", "DY"), F.slice(gaps, 1, 1)).otherwise(fallback)


def solved(picked: Column, expected: Column) -> Column:
    return F.coalesce(F.array_contains(expected, picked), F.lit(False))


def certify(runs: DataFrame, *by: str) -> DataFrame:
    """runs (case_id, solved) -> solved and failed counts, difficulty, and one of robust (0 solved), borderline (up to n // 5), too_easy."""
    out = runs.groupBy("case_id", *by).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("solved").alias("n_solved"))
    fifth = F.floor(F.col("n_runs") / 5)
    kind = F.when(F.col("n_solved") == 0, "robust").when(F.col("n_solved") <= fifth, "borderline").otherwise("too_easy")
    return out.withColumns({"n_failed": F.col("n_runs") - F.col("n_solved"), "difficulty": F.round((F.col("n_runs") - F.col("n_solved")) / F.col("n_runs") + 1e-10, 4), "verdict": kind})


def summary(certified: DataFrame, *by: str) -> DataFrame:
    """Cases, verdicts, share of robust ones, mean difficulty; all cases or by columns."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return certified.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[count(v).alias(v) for v in ("robust", "borderline", "too_easy")], F.round(100.0 * count("robust") / F.count(F.lit(1)), 1).alias("robust_pct"), F.round(F.avg("difficulty") + 1e-10, 4).alias("mean_difficulty"))


def subset_summary(certified: DataFrame, modes: tuple[str, ...], mode: str = "mode") -> DataFrame:
    """One row for the cases of some modes together: cases, robust ones, their share, mean difficulty."""
    return summary(certified.filter(F.col(mode).isin(*modes))).select("cases", "robust", "robust_pct", "mean_difficulty")


def ids_by_verdict(certified: DataFrame) -> DataFrame:
    """(verdict, case_ids in order)."""
    return certified.groupBy("verdict").agg(F.array_sort(F.collect_list("case_id")).alias("case_ids"))


def missing_runs(cases: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """(case_id, run) still to do: resuming is an anti-join with what is done."""
    wanted = cases.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("run"))
    return wanted.join(runs.select("case_id", "run").distinct(), ["case_id", "run"], "left_anti")


def annotate(cases: DataFrame, provenance: DataFrame, recertified: DataFrame) -> DataFrame:
    """Cases with a certification block: the one they have stays, else it comes from the new runs."""
    out = cases.join(provenance.select("case_id", "block"), "case_id", "left").join(recertified.select("case_id", F.struct("n_runs", "n_solved", "verdict").alias("_new")), "case_id", "left")
    return out.withColumn("block", F.coalesce("block", F.to_json("_new"))).drop("_new")


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """ranked (case_id, item, rank) against expected (case_id, item): P@1, R@5 and MRR as means over cases."""
    hits = ranked.join(expected, ["case_id", "item"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= 5).alias("in5"))
    sizes = expected.groupBy("case_id", *by).agg(F.count_distinct("item").alias("m"))
    c = sizes.join(hits, "case_id", "left")
    mean = lambda x: F.round(F.avg(x) + 1e-10, 4)
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), mean(F.when(F.col("first") == 1, 1.0).otherwise(0.0)).alias("p_at_1"), mean(F.coalesce(F.least(F.lit(1.0), F.col("in5") / F.col("m")), F.lit(0.0))).alias("r_at_5"), mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def mark_best(scores: DataFrame, *measures: str) -> DataFrame:
    """A flag beside each measure: equal to the best of all rows."""
    everything = Window.partitionBy()
    return scores.withColumns({f"{m}_best": F.col(m) == F.max(m).over(everything) for m in measures})
