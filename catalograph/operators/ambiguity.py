"""Rankings and rollups over the pair table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import difficulty_band, problem_labels, round4, tier
from ..schema import COVERAGE_GAP, GROUND_TRUTH_TYPES, TIER_MINIMUM, TIERS, TOP_K
from ..session import written
from . import blocks
from .blocks import block_counts
from .features import text_vectors
from .pairs import background, mirror


def _rank(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("seq_a").orderBy(*order))


def _by_sim() -> list[Column]:
    return [F.col("sim").desc(), F.col("seq_b").asc()]


def top_neighbours(pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k most similar candidates of each resource, ties by seq. Only pairs that share a key."""
    return mirror(pairs).withColumn("rank", _rank(_by_sim())).filter(F.col("rank") <= k)


def completed_neighbours(pairs: DataFrame, resources: DataFrame, k: int = TOP_K) -> DataFrame:
    """(seq_a, seq_b, sim, rank): the k most similar of all resources, pairs that share nothing included.

    A background score depends on two facts only, so for each resource and each of the four classes of others (namespace
    and type equal or not) the first k + c by seq are enough, c being the candidates of the resource in that class; as
    only resources whose kth candidate lies at or below the best background can gain, the others are not expanded.
    """
    near = mirror(pairs).select("seq_a", "seq_b", "sim")
    ranked = near.withColumn("rank", _rank(_by_sim())).filter(F.col("rank") <= k)
    best = background(F.lit(False), F.lit(True))
    settled = ranked.groupBy("seq_a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")).filter((F.col("n") == k) & (F.col("least") > best)).select("seq_a")
    meta = resources.select("seq", "namespace", "type")
    open_ = meta.withColumnRenamed("seq", "seq_a").join(settled, "seq_a", "left_anti")
    # Candidates of open resources are ranked out of the way by an anti-join against the first others of each class.
    taken = near.join(open_.select("seq_a"), "seq_a", "left_semi")
    most = taken.groupBy("seq_a").agg(F.count(F.lit(1)).alias("c"))
    first = meta.withColumn("nth", F.row_number().over(Window.partitionBy("namespace", "type").orderBy("seq")))
    other = first.select(F.col("seq").alias("seq_b"), F.col("namespace").alias("ns_b"), F.col("type").alias("type_b"), "nth")
    wide = open_.join(most, "seq_a", "left").withColumn("want", F.coalesce("c", F.lit(0)) + k + 1)
    extra = wide.join(other, (F.col("nth") <= F.col("want")) & (F.col("seq_a") != F.col("seq_b")))
    extra = extra.join(taken.select("seq_a", "seq_b"), ["seq_a", "seq_b"], "left_anti")
    extra = extra.select("seq_a", "seq_b", background(F.col("namespace") == F.col("ns_b"), F.col("type") == F.col("type_b")).alias("sim"))
    both = ranked.join(settled, "seq_a", "left_semi").select("seq_a", "seq_b", "sim").unionByName(taken).unionByName(extra)
    return both.withColumn("rank", _rank(_by_sim())).filter(F.col("rank") <= k)


def ranked_neighbours(found: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best rows of each resource among those of block_neighbours()."""
    return found.withColumn("rank", _rank(_by_sim())).filter(F.col("rank") <= k).select("seq_a", "seq_b", "sim", "rank")


def counts_above(pairs: DataFrame) -> DataFrame:
    """(seq, n): neighbours at the gap threshold."""
    return mirror(pairs).filter(F.col("sim") >= COVERAGE_GAP).groupBy(F.col("seq_a").alias("seq")).agg(F.count(F.lit(1)).alias("n"))


def resource_ambiguity(neighbours: DataFrame, above: DataFrame, resources: DataFrame) -> DataFrame:
    """Score (mean of the ranked sims), band, number of neighbours at the gap threshold (above: seq, n), gap flag, eligibility as ground truth."""
    score = neighbours.groupBy(F.col("seq_a").alias("seq")).agg(F.avg("sim").alias("mean_sim"))
    out = resources.select("seq", "namespace", "type").join(score, "seq", "left").join(above, "seq", "left")
    mean = F.coalesce("mean_sim", F.lit(0.0))
    # The band tests the mean before rounding; the guard keeps sums in another order on the same side.
    return out.select(
        "seq",
        "namespace",
        "type",
        round4(mean).alias("ambiguity_score"),
        difficulty_band(mean + F.lit(1e-10)).alias("difficulty_band"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_neighbors_above_threshold"),
        (F.coalesce("n", F.lit(0)) == 0).alias("coverage_gap"),
        F.col("type").isin(*GROUND_TRUTH_TYPES).alias("can_be_ground_truth"),
    )


def band_summary(report: DataFrame) -> DataFrame:
    """One row: totals, bands, gaps, and the page counters."""
    count = lambda c: F.count_if(c).alias
    band = F.col("difficulty_band")
    return report.agg(F.count(F.lit(1)).alias("total_resources"), *[count(band == b)(b) for b in ("easy", "medium", "hard", "very_hard")], count(F.col("coverage_gap"))("coverage_gaps"), count(band.isin("hard", "very_hard"))("hard_or_more"))


def namespace_summary(report: DataFrame) -> DataFrame:
    """By namespace: mean rounded score, resources, hard ones (rounded score >= 0.4), gaps."""
    return report.groupBy("namespace").agg(round4(F.avg("ambiguity_score")).alias("mean_ambiguity"), F.count(F.lit(1)).alias("n_resources"), F.count_if(F.col("ambiguity_score") >= 0.40).alias("n_hard"), F.count_if("coverage_gap").alias("n_gaps"))


def tier_windows(high_cap: float | None = None) -> dict[str, tuple[float, float]]:
    """The tiers as windows of scores."""
    above = [math.inf, *[low for _, low in TIERS]]
    out = {name: (low, high) for (name, low), high in zip(TIERS, above)}
    if high_cap is not None:
        out = {name: (low, min(high, high_cap)) for name, (low, high) in out.items()}
    return out


def counted_tiers(resources: DataFrame, high_cap: float | None = None, use_text: bool = True) -> DataFrame:
    """tier_counts() of all resources, counted inside the blocks."""
    return tier_totals(block_counts(resources, tier_windows(high_cap), "namespace", use_text), resources)


#: Groups in which settled_tiers() counts first, at most.
GROUPS = 256


def settled_tiers(resources: DataFrame, tiers: tuple[str, ...] = tuple(TIER_MINIMUM)) -> DataFrame:
    """counted_tiers() for questions about the minima of `tiers` alone: what they still need is exact, and so is done if all are asked; counts of resources that need nothing are at least the minima.

    Counts only grow with the pairs, so a resource that has its minima among the others of its own group needs no further pair. The
    rest, few where neighbours are many, is counted against all resources; whatever they are, no pair that could change an answer is left out.
    """
    k = min(GROUPS, -(-resources.count() // blocks.BLOCK))
    if k < 2:
        return counted_tiers(resources)
    texts = written(text_vectors(resources), "texts")
    own = F.pmod(F.xxhash64(F.lit("group"), F.col("seq")), F.lit(k)).cast("string")
    near = written(block_counts(resources, tier_windows(), "namespace", texts=texts, within=own), "near")
    needs = F.lit(False)
    for t in tiers:
        needs = needs | (F.col(f"{t}_needed") > 0)
    open_ = written(tier_totals(near, resources).filter(needs).select("seq"), "open")
    if open_.isEmpty():
        return tier_totals(near, resources)
    rest = block_counts(resources, tier_windows(), "namespace", texts=texts, left=open_).join(open_, "seq", "left_semi")
    return tier_totals(near.join(open_, "seq", "left_anti").unionByName(rest), resources)


def tier_counts(pairs: DataFrame, resources: DataFrame, high_cap: float | None = None) -> DataFrame:
    """For each resource: neighbours by tier, what is missing, distinct namespaces by tier, and whether all minima are met."""
    windows = tier_windows(high_cap)
    inside = lambda t: F.count_if((F.col("sim") >= windows[t][0]) & (F.col("sim") < windows[t][1])).alias(t)
    near = mirror(pairs).groupBy(F.col("seq_a").alias("seq"), F.col("ns_b").alias("label")).agg(*[inside(t) for t in windows])
    return tier_totals(near, resources)


def tier_totals(near: DataFrame, resources: DataFrame) -> DataFrame:
    """tier_counts() from counts by resource and namespace of the neighbours (seq, label, high, medium, low)."""
    counts = near.groupBy("seq").agg(*[F.sum(t).alias(t) for t in TIER_MINIMUM], *[F.count_if((F.col(t) > 0) & F.col("label").isNotNull()).alias(f"{t}_namespaces") for t in TIER_MINIMUM])
    out = resources.select("seq", "namespace", "type").join(counts, "seq", "left")
    have = {t: F.coalesce(t, F.lit(0)).cast("long") for t in TIER_MINIMUM}
    done = have["high"] >= TIER_MINIMUM["high"]
    for t in ("medium", "low"):
        done = done & (have[t] >= TIER_MINIMUM[t])
    return out.select("seq", "namespace", "type", *[c.alias(t) for t, c in have.items()], *[F.greatest(F.lit(0), F.lit(TIER_MINIMUM[t]) - c).cast("long").alias(f"{t}_needed") for t, c in have.items()], *[F.coalesce(f"{t}_namespaces", F.lit(0)).cast("long").alias(f"{t}_namespaces") for t in TIER_MINIMUM], done.alias("done"))


def progress(counts: DataFrame) -> DataFrame:
    """By type: resources, how many meet each tier and all; plus totals of directed neighbours halved."""
    met = [F.count_if(F.col(t) >= n).alias(f"{t}_met") for t, n in TIER_MINIMUM.items()]
    halves = [F.floor(F.sum(t) / 2).cast("long").alias(f"{t}_pairs") for t in TIER_MINIMUM]
    return counts.groupBy("type").agg(F.count(F.lit(1)).alias("n"), *met, F.count_if("done").alias("all_met"), *halves)


def all_done(counts: DataFrame) -> DataFrame:
    """Whether every ground-truth type resource meets all minima."""
    return counts.filter(F.col("type").isin(*GROUND_TRUTH_TYPES)).agg(F.coalesce(F.bool_and("done"), F.lit(True)).alias("all_done"), F.count(F.lit(1)).alias("n"))


def top_pairs(neighbours: DataFrame, n: int = 20, least: float = COVERAGE_GAP) -> DataFrame:
    """The n most similar unordered pairs of the ranked lists; the direction seen first (by seq, rank) stays."""
    seen = Window.partitionBy(F.least("seq_a", "seq_b"), F.greatest("seq_a", "seq_b")).orderBy("seq_a", "rank")
    once = neighbours.filter(F.col("sim") >= least).withColumn("_nth", F.row_number().over(seen)).filter("_nth = 1").drop("_nth")
    return once.orderBy(F.col("sim").desc(), "seq_a", "rank").limit(n)


def preselect_pairs(neighbours: DataFrame, report: DataFrame, n: int = 50, least: float = COVERAGE_GAP) -> DataFrame:
    """The n most similar directed pairs whose first end may be ground truth, with the band of that end."""
    first = report.filter(F.col("type").isin(*GROUND_TRUTH_TYPES)).select(F.col("seq").alias("seq_a"), F.col("difficulty_band").alias("correct_difficulty_band"))
    return neighbours.filter(F.col("sim") >= least).join(first, "seq_a").orderBy(F.col("sim").desc(), "seq_a", "rank").limit(n)


def with_problems(pairs: DataFrame) -> DataFrame:
    """Pairs with rounded parts and problem labels."""
    rounded = pairs.withColumns({c: round4(F.col(c)) for c in ("text", "localId", "entityTypes", "lineOfBusiness", "tags", "industry")})
    return rounded.withColumn("problems", problem_labels(F.col("ns_a") != F.col("ns_b"), F.col("entityTypes"), F.col("tags"), F.col("text")))


def coverage_gaps(report: DataFrame, n: int = 10) -> DataFrame:
    """The first n resources of ground-truth types without a neighbour at the threshold."""
    return report.filter(F.col("coverage_gap") & F.col("type").isin(*GROUND_TRUTH_TYPES)).orderBy("seq").limit(n)


def landscape_table(resources: DataFrame) -> DataFrame:
    """Namespace by type counts with ground-truth counts and a grand total row (namespace null)."""
    return resources.rollup("namespace").agg(*[F.count_if(F.col("type") == t).alias(t) for t in ("apiResource", "agent", "dataProduct", "entityType", "event")], F.count_if(F.col("type").isin(*GROUND_TRUTH_TYPES)).alias("ground_truth"), F.count(F.lit(1)).alias("total"))


def type_shares(resources: DataFrame) -> DataFrame:
    """(type, n, share in %) of the resources."""
    counts = resources.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("type", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1).alias("share"))


def mean_top_ambiguity(neighbours: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Mean over resources of the mean of their ranked sims."""
    rows = neighbours.join(among.select(F.col("seq").alias("seq_a")), "seq_a", "left_semi") if among is not None else neighbours
    return rows.groupBy("seq_a").agg(F.avg("sim").alias("m")).agg(round4(F.avg("m")).alias("mean_ambiguity"), F.count(F.lit(1)).alias("n"))


def page_counters(report: DataFrame, tier_counts: DataFrame) -> DataFrame:
    """One row over ground truth types: all, eligible (every tier met), with three HIGH neighbours, hard or very hard, coverage gaps, greatest score."""
    r = report.filter("can_be_ground_truth").join(tier_counts.select("seq", "high", "done"), "seq", "left")
    return r.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("done", F.lit(False))).alias("eligible"),
        F.count_if(F.coalesce("high", F.lit(0)) >= TIER_MINIMUM["high"]).alias("with_high"),
        F.count_if(F.col("difficulty_band").isin("hard", "very_hard")).alias("hard_or_more"),
        F.count_if("coverage_gap").alias("coverage_gaps"),
        F.coalesce(F.max("ambiguity_score"), F.lit(1.0)).alias("max_score"),
    )


def shown_rows(report: DataFrame, only_eligible: bool = False, types: tuple[str, ...] = (), eligible: str = "eligible") -> DataFrame:
    """Rows of the page: eligible ones if asked for, and of the chosen types (all if none is chosen)."""
    shown = report.filter(F.col(eligible)) if only_eligible else report
    return shown.filter(F.col("type").isin(*types)) if types else shown


def neighbour_table(pairs: DataFrame, tiers: tuple[str, ...] = (), by: str = "sim", ascending: bool = False) -> DataFrame:
    """The neighbours of each resource (mirrored pairs) in the chosen tiers (all if none is chosen), numbered by a column, ties by seq."""
    rows = pairs.withColumn("tier", tier(F.col("sim")))
    rows = rows.filter(F.col("tier").isin(*tiers)) if tiers else rows
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("seq_a").orderBy(order, "seq_b")))
