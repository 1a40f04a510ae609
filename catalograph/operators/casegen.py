"""Generation of test cases: seeds are tried until a prompt passes all gates, and the first accepted ones are numbered.

Every attempt is one pass over all seeds that are still open, not a loop over seeds: writing, solving and judging are hooks from
DataFrame to DataFrame (a model call is a mapInPandas there). Which seeds become cases depends on their order alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distractor_label, id_segment
from ..session import shared_folder
from .reduction import hash_order

Hook = Callable[[DataFrame], DataFrame]


def _kept(df: DataFrame) -> DataFrame:
    """df as a table: hooks run once."""
    path = shared_folder(df.sparkSession, "attempts")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def skill_seeds(skills: DataFrame, seed: int, passes: int = 3) -> DataFrame:
    """Skills (skill_id, gt_ids) with ids, in seeded order, several times over: (seed, place, grp, expected, solver_ids)."""
    rows = skills.filter(F.size("gt_ids") > 0).select("skill_id", "gt_ids", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("nth"))
    return rows.select(F.concat_ws("#", "skill_id", "nth").alias("seed"), F.struct("nth", hash_order(F.col("skill_id"), seed=seed).alias("h"), "skill_id").alias("place"), F.col("skill_id").alias("grp"), F.col("gt_ids").alias("expected"), F.slice("gt_ids", 1, 1).alias("solver_ids"))


def gap_seeds(skills: DataFrame, similarity: DataFrame, eligible: DataFrame, seed: int, n: int = 2, least: float = 0.25) -> DataFrame:
    """For each skill n resources outside it: of the 3 * n most similar eligible ones those first in seeded order. similarity: (skill, id, sim); eligible: (id)."""
    near = similarity.filter(F.col("sim") >= least).join(eligible.select("id"), "id", "left_semi")
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("skill").orderBy(F.col("sim").desc(), "id"))).filter(F.col("_r") <= 3 * n)
    pick = F.row_number().over(Window.partitionBy("skill").orderBy(hash_order(F.col("skill"), F.col("id"), seed=seed), "id"))
    gaps = near.withColumn("_n", pick).filter(F.col("_n") <= n).groupBy("skill").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias("ids"))
    s = skills.select(F.col("skill_id").alias("skill")).join(gaps, "skill")
    return s.select(F.col("skill").alias("seed"), F.struct(hash_order(F.col("skill"), seed=seed).alias("h"), "skill").alias("place"), F.col("skill").alias("grp"), F.col("ids").alias("expected"), F.col("ids").alias("solver_ids"))


def single_seeds(eligible: DataFrame, distractors: DataFrame, seed: int) -> DataFrame:
    """Eligible resources (id, entity_types) in seeded order, each with its distractor (id, distractor, distractor_types) or null, and the problem it exercises."""
    j = eligible.join(distractors, "id", "left")
    ns = lambda c: id_segment(F.col(c), 0)
    label = distractor_label(ns("id"), F.col("entity_types"), ns("distractor"), F.col("distractor_types"))
    return j.select(F.col("id").alias("seed"), F.struct(hash_order(F.col("id"), seed=seed).alias("h"), "id").alias("place"), F.col("id").alias("grp"), F.array("id").alias("expected"), F.array("id").alias("solver_ids"), "distractor", label.alias("problem"))


def multi_seeds(eligible: DataFrame, seed: int) -> DataFrame:
    """Pairs of eligible resources (id, namespace) of different systems: the nth of every system in seeded order, two by two. Each resource is in one pair."""
    order = hash_order(F.col("id"), seed=seed)
    nth = F.row_number().over(Window.partitionBy("namespace").orderBy(order, "id"))
    ranked = eligible.select("id", "namespace", order.alias("h")).withColumn("nth", nth)
    at = F.row_number().over(Window.partitionBy("nth").orderBy("h", "id")) - 1
    pairs = ranked.withColumn("two", F.floor(at / 2)).groupBy("nth", "two").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "id"))), lambda x: x["id"]).alias("ids")).filter(F.size("ids") == 2)
    return pairs.select(F.concat_ws("+", "ids").alias("seed"), F.struct("nth", "two").alias("place"), F.concat_ws("+", "ids").alias("grp"), F.col("ids").alias("expected"), F.slice("ids", 1, 1).alias("solver_ids"))


def not_covered(expected: Column, skills: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with covering: a skill that holds all of several expected ids (null if none does)."""
    several = rows.filter(F.size(expected) > 1).select("seed", F.explode(expected).alias("id"))
    held = several.join(skills.select(F.col("skill_id").alias("covering"), F.explode("gt_ids").alias("id")).distinct(), "id").groupBy("seed", "covering").agg(F.count_distinct("id").alias("n"))
    whole = held.join(rows.select("seed", F.size(F.array_distinct(expected)).alias("m")), "seed").filter("n = m").groupBy("seed").agg(F.min("covering").alias("covering"))
    return rows.join(whole, "seed", "left")


def generate_cases(seeds: DataFrame, prefix: str, write: Callable[[DataFrame, int], DataFrame], check: Hook, judge: Hook, solve: Hook | None = None, attempts: int = 5, target: int = 20, per_group: int | None = None, fallback: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases (case_id, seed, prompt, measured), provenance (seed, outcome, evolution_log)).

    seeds: (seed, place, grp, expected, solver_ids[, distractor]). write adds `prompt`; check adds `failure`, null if it is fine; solve adds
    `predicted`; judge adds `judged`. A prompt that the solver solves is too easy. Without an accepted attempt, fallback takes the last prompt that
    passed check() where there is a distractor: such a case is not measured.
    """
    columns = ["seed", "attempt", "outcome", "prompt", "predicted", "failure"]
    open_, log = seeds, None
    for attempt in range(1, attempts + 1):
        rows = _kept(check(write(open_, attempt)).withColumn("attempt", F.lit(attempt)))
        failed = rows.filter("failure IS NOT NULL").withColumns({"outcome": F.lit("VALIDATOR_FAIL"), "predicted": F.lit(None).cast("string")})
        fine = rows.filter("failure IS NULL")
        fine = _kept(solve(fine)) if solve else fine.withColumn("predicted", F.lit(None).cast("string"))
        easy = F.coalesce(F.array_contains("solver_ids", F.col("predicted")), F.lit(False))
        hard = judge(fine.filter(~easy)).withColumn("outcome", F.when(F.col("judged"), "ACCEPTED").otherwise("JUDGE_FAIL"))
        step = _kept(failed.select(*columns).unionByName(fine.filter(easy).withColumn("outcome", F.lit("TOO_EASY")).select(*columns)).unionByName(hard.select(*columns)))
        log = step if log is None else log.unionByName(step)
        open_ = open_.join(step.filter("outcome = 'ACCEPTED'"), "seed", "left_anti")
        if open_.isEmpty():
            break
    entry = F.struct("attempt", "outcome", "prompt", "predicted", "failure")
    last = F.max_by(F.struct("prompt", F.col("outcome").alias("how")), F.when(F.col("failure").isNull(), F.col("attempt")))
    out = seeds.join(log.groupBy("seed").agg(F.array_sort(F.collect_list(entry)).alias("evolution_log"), F.bool_or(F.col("outcome") == "ACCEPTED").alias("accepted"), last.alias("last")), "seed")
    saved = F.col("last").isNotNull() & F.col("distractor").isNotNull() if fallback else F.lit(False)
    out = out.withColumn("outcome", F.when(F.col("accepted"), "accepted").when(saved, "distractor_certified").otherwise("gave_up"))
    good = out.filter("outcome <> 'gave_up'")
    if per_group is not None:
        good = good.withColumn("_g", F.row_number().over(Window.partitionBy("grp").orderBy("place"))).filter(F.col("_g") <= per_group)
    first = good.orderBy("place").limit(target).withColumn("_n", F.row_number().over(Window.orderBy("place")))
    cases = first.select(F.format_string(f"{prefix}-%02d", "_n").alias("case_id"), "seed", F.col("last.prompt").alias("prompt"), (F.col("outcome") == "accepted").alias("measured"))
    return cases, out.select("seed", "outcome", "evolution_log")
