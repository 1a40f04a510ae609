"""Near-duplicate reduction and growth: the deterministic parts of the loops, with hooks for what a model decides."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import jaccard
from ..schema import DOMAIN_CLUSTERS, NEAR_DUPLICATE, TIER_MINIMUM, TIERS, TOP_K, TYPE_SHARES
from ..session import few
from .ambiguity import mean_top_ambiguity
from .pairs import mirror, similarity
from .topk import bounded_neighbours

HIGH = dict(TIERS)["high"]


def high_without(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """near (seq_a, seq_b) with high_a and high_b: neighbours in [HIGH, NEAR_DUPLICATE) of each end.

    The partner itself is at or above the upper end, so no neighbour has to be left out.
    """
    counts = mirror(pairs.select("seq_a", "seq_b", "sim")).filter((F.col("sim") >= HIGH) & (F.col("sim") < NEAR_DUPLICATE)).groupBy("seq_a").agg(F.count(F.lit(1)).alias("h"))
    side = lambda s: counts.select(F.col("seq_a").alias(f"seq_{s}"), F.col("h").alias(f"high_{s}"))
    return near.join(side("a"), "seq_a", "left").join(side("b"), "seq_b", "left").fillna(0, ["high_a", "high_b"])


def decide(high_a: Column, high_b: Column, need: int = TIER_MINIMUM["high"]) -> Column:
    """drop_b if both ends or B alone keep enough HIGH neighbours, drop_a if A alone does, else rewrite_b."""
    return F.when(high_b >= need, "drop_b").when(high_a >= need, "drop_a").otherwise("rewrite_b")


def independent(near: DataFrame) -> DataFrame:
    """The pairs that come first at both of their ends by sim, descending, and a hash of the pair: none shares a resource, so all can be decided at once.

    The hash spreads ties: of n equal copies about n / 4 pairs come first, by seq it would be one.
    """
    order = [F.col("sim").desc(), F.col("seq_a"), F.col("seq_b")]
    ranked = near.withColumn("_o", F.struct(-F.col("sim"), F.xxhash64("seq_a", "seq_b"), "seq_a", "seq_b"))
    ends = ranked.select("_o", F.explode(F.array("seq_a", "seq_b")).alias("end"))
    best = ends.groupBy("end").agg(F.min("_o").alias("_best"))
    a, b = best.select(F.col("end").alias("seq_a"), F.col("_best").alias("_ba")), best.select(F.col("end").alias("seq_b"), F.col("_best").alias("_bb"))
    return ranked.join(a, "seq_a").join(b, "seq_b").filter("_o = _ba AND _o = _bb").drop("_o", "_ba", "_bb").orderBy(*order)


def reduce_near_duplicates(resources: DataFrame, pairs_of: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame, DataFrame], DataFrame] | None = None, rounds: int = 100, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(resources left, decisions). Each round scores the current resources and decides an independent set of near-duplicates, until none is left.

    rewrite(resources, decided) returns the resources with B of its pairs rewritten; without it, or for a pair met
    again, B is dropped. Rewriting ends after half of `rounds`; from then on every round drops a resource. cut writes a snapshot (for example to the checkpoint folder) so that the plan does not grow.
    """
    decisions = None
    for r in count():
        pairs = cut(pairs_of(resources))
        first = cut(independent(high_without(pairs, pairs.filter(F.col("sim") >= NEAR_DUPLICATE).select("seq_a", "seq_b", "sim"))).withColumn("action", decide(F.col("high_a"), F.col("high_b"))).withColumn("round", F.lit(r)))
        if first.isEmpty():
            break
        again = rewrite is not None and r < rounds // 2
        gone = first.select(F.when(F.col("action") == "drop_a", F.col("seq_a")).when((F.col("action") == "drop_b") | F.lit(not again), F.col("seq_b")).alias("seq")).filter("seq IS NOT NULL")
        if again:
            resources = rewrite(resources, first.filter("action = 'rewrite_b'"))
        resources = cut(resources.join(gone, "seq", "left_anti"))
        decisions = first if decisions is None else decisions.unionByName(first)
    if decisions is None:
        decisions = first
    return resources, decisions


# Growth. The lines of business of candidate_profiles().


def gaps(tier_counts: DataFrame) -> DataFrame:
    """(seq, tier, missing): HIGH gaps before MEDIUM ones, each by seq, a resource once (its first)."""
    rows = tier_counts.select("seq", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("high").alias("tier"), F.col("high_needed").alias("missing")), F.struct(F.lit(1).alias("o"), F.lit("medium").alias("tier"), F.col("medium_needed").alias("missing")))).alias("g")).select("seq", "g.*").filter("missing > 0")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("seq").orderBy("o"))).filter("_n = 1").orderBy("o", "seq").select("seq", "tier", "missing")


def convergence(scored: DataFrame, rounds: list[int], k: int = TOP_K) -> DataFrame:
    """(round, mean_ambiguity, n): the text-free ambiguity of all resources up to each round, rarity counted anew for each.

    scored: with a column `round`. Rounds are few; each is one score of its prefix.
    """
    parts = []
    for r in rounds:
        # Only blocks that may hold a better neighbour are looked at.
        found = bounded_neighbours(scored.filter(F.col("round") <= r), k, use_text=False)
        parts.append(mean_top_ambiguity(found).select(F.lit(r).alias("round"), "mean_ambiguity", "n"))
    return reduce(DataFrame.unionByName, parts)


def next_type(resources: DataFrame) -> DataFrame:
    """(type, deficit): the type furthest below its share; ties in the order of the shares."""
    target = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(t).alias("type"), F.lit(s).alias("share")) for i, (t, s) in enumerate(TYPE_SHARES.items())])
    n = resources.agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPE_SHARES], F.greatest(F.lit(1), F.count_if(F.col("type").isin(*TYPE_SHARES))).alias("all"))
    have = F.create_map(*[x for t in TYPE_SHARES for x in (F.lit(t), F.col(t))])
    rows = n.select(F.explode(target).alias("t"), have.alias("have"), "all").select("t.o", "t.type", (F.col("t.share") - F.col("have")[F.col("t.type")] / F.col("all")).alias("deficit"))
    return rows.orderBy(F.col("deficit").desc(), "o").limit(1).select("type", F.round("deficit", 6).alias("deficit"))


def namespaces_below_cap(resources: DataFrame, total: int) -> DataFrame:
    """(namespace, n): namespaces under ceil(total / namespaces), the smallest first, ties by first seq."""
    counts = resources.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    cap = F.ceil(F.lit(total) / F.count(F.lit(1)).over(Window.partitionBy()))
    return counts.withColumn("cap", cap).filter("n < cap").orderBy("n", "first").select("namespace", "n")


def cluster_of(namespaces: DataFrame) -> DataFrame:
    """namespaces (namespace) with their first domain cluster, or null."""
    rows = [(i, c, s) for i, (c, systems) in enumerate(DOMAIN_CLUSTERS) for s in systems]
    lookup = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(c).alias("cluster"), F.lit(s).alias("system")) for i, c, s in rows])
    return namespaces.withColumn("cluster", F.get(F.transform(F.filter(lookup, lambda x: x["system"] == F.col("namespace")), lambda x: x["cluster"]), F.lit(0)))


def related_systems(namespaces: DataFrame, inside: bool = True) -> DataFrame:
    """(namespace, others[]): other systems of its cluster (inside) or outside it; all others if there are none."""
    members = {c: s for c, s in DOMAIN_CLUSTERS}
    own = F.create_map(*[x for c, s in members.items() for x in (F.lit(c), F.array(*map(F.lit, s)))])
    known = cluster_of(namespaces)
    every = few(namespaces.select("namespace").distinct()).agg(F.array_sort(F.collect_set("namespace")).alias("every"))
    j = known.crossJoin(F.broadcast(every)).withColumn("others", F.array_remove(F.col("every"), F.col("namespace")))
    cluster = F.coalesce(F.when(F.col("cluster").isNotNull(), F.try_element_at(own, F.col("cluster"))), F.array().cast("array<string>"))
    found = F.array_intersect("others", cluster) if inside else F.array_except("others", cluster)
    return j.select("namespace", F.when(F.size(found) > 0, found).otherwise(F.col("others")).alias("others"))


def candidate_profiles(target: DataFrame, tier_name: str, other_types: dict[str, str] = {"agent": "apiResource", "apiResource": "dataProduct", "dataProduct": "agent"}, all_types: DataFrame | None = None, bridges: tuple[str, ...] = ()) -> DataFrame:  # noqa: B006
    """Attribute profiles to try for a tier, in order: (seq, strategy_no, type, namespace, entity_types, line_of_business, tags).

    target: one or more resources with `new_type` and `new_namespace`. Ids are sorted where the order is free. The first
    profile whose text-free score lies in the tier is the one to take (first_fitting).
    """
    ets, lob, tags = F.array_sort("entity_types"), F.col("line_of_business"), F.col("tags")
    none = F.array().cast("array<string>")
    entry = lambda e, line, t, kind=None: F.struct((F.col("new_type") if kind is None else kind).alias("type"), F.col("new_namespace").alias("namespace"), e.alias("entity_types"), line.alias("line_of_business"), t.alias("tags"))
    one = lambda s: F.array(F.lit(s))
    if tier_name == "high":
        tries = F.array(entry(ets, lob, tags), entry(ets, lob, none))
    elif tier_name == "medium":
        two = F.when(F.size(ets) >= 2, F.array(*[entry(F.slice(ets, 1, 2), x, none) for x in (none, one("Finance"), one("Operations"))]))
        whole = F.filter(F.array(*[entry(ets, x, none) for x in (none, one("Finance"), one("Operations"), one("Manufacturing"))]), lambda p: p["line_of_business"] != lob)
        same = F.when(F.col("new_namespace") == F.col("namespace"), F.transform(F.when(F.size(ets) > 0, F.sequence(F.lit(1), F.size(ets))).otherwise(F.array().cast("array<int>")), lambda n: entry(F.slice(ets, 1, n), lob, none)))
        single = F.transform(ets, lambda e: entry(F.array(e), lob, none))
        bridge = [entry(F.array(F.lit(b)), x, none) for b in bridges for x in (none, lob)]
        empty = F.array_remove(F.array(entry(none, none, none)), entry(none, none, none))
        tries = F.concat(F.coalesce(two, empty), whole, F.coalesce(same, empty), single, *([F.array(*bridge)] if bridge else []))
    else:
        alt = F.create_map(*[F.lit(x) for kv in other_types.items() for x in kv])[F.col("new_type")]
        tries = F.transform(F.slice(ets, 1, 3), lambda e: entry(F.array(e), none, none, alt))
        if all_types is not None:
            target = target.crossJoin(F.broadcast(few(all_types.select("entity_type").distinct()).agg(F.array_sort(F.collect_set("entity_type")).alias("_all"))))
            tries = F.concat(tries, F.transform(F.slice(F.array_except("_all", ets), 1, 10), lambda e: entry(F.array(e), none, none)))
    return target.select("seq", F.posexplode(tries).alias("strategy_no", "p")).select("seq", "strategy_no", "p.*")


def profile_scores(tries: DataFrame, target: DataFrame, idf: DataFrame) -> DataFrame:
    """(seq, strategy_no, sim) of profiles against their own target by the text-free metric, with the rarities idf (entity_type, idf)."""
    own = target.select("seq", *[F.col(c).alias(f"t_{c}") for c in ("namespace", "type", "entity_types", "line_of_business", "tags")])
    both = tries.join(own, "seq")
    kinds = both.select("seq", "strategy_no", F.explode(F.array_union("entity_types", "t_entity_types")).alias("entity_type"), F.array_intersect("entity_types", "t_entity_types").alias("shared"))
    kinds = kinds.join(idf.select("entity_type", "idf"), "entity_type").groupBy("seq", "strategy_no").agg(F.sum("idf").alias("_union"), F.sum(F.when(F.array_contains("shared", F.col("entity_type")), F.col("idf")).otherwise(0.0)).alias("_shared"))
    j = both.join(kinds, ["seq", "strategy_no"], "left")
    parts = {"entityTypes": F.when(F.col("_union") > 0, F.col("_shared") / F.col("_union")).otherwise(0.0), "lineOfBusiness": jaccard(F.col("line_of_business"), F.col("t_line_of_business")), "tags": jaccard(F.col("tags"), F.col("t_tags"))}
    return j.select("seq", "strategy_no", similarity(parts, F.col("namespace") == F.col("t_namespace"), F.col("type") == F.col("t_type")).alias("sim"))


def nth_candidate(scores: DataFrame, n: int, target: str = "target_seq", candidate: str = "seq", by: str = "sim") -> DataFrame:
    """For each target its n-th best candidate: one for each attempt, ties by seq."""
    rank = F.row_number().over(Window.partitionBy(target).orderBy(F.col(by).desc(), candidate))
    return scores.withColumn("_n", rank).filter(F.col("_n") == n).drop("_n")


def first_fitting(scored_profiles: DataFrame, tier_name: str) -> DataFrame:
    """(seq, strategy_no, sim) of the first profile inside the tier."""
    names = [t for t, _ in TIERS]
    low = dict(TIERS)[tier_name]
    i = names.index(tier_name)
    high = TIERS[i - 1][1] if i else 2.0
    inside = scored_profiles.filter((F.col("sim") >= low) & (F.col("sim") < high))
    return inside.groupBy("seq").agg(F.min_by(F.struct("strategy_no", "sim"), "strategy_no").alias("b")).select("seq", "b.strategy_no", "b.sim")


def aligned(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """candidates (seq, target_seq, ...) as if aligned to their targets: entity types and lines of business taken over, tags joined."""
    t = targets.select(F.col("seq").alias("target_seq"), F.col("entity_types").alias("_e"), F.col("line_of_business").alias("_l"), F.col("tags").alias("_t"))
    j = candidates.join(t, "target_seq")
    return j.withColumns({"entity_types": F.col("_e"), "line_of_business": F.col("_l"), "tags": F.array_union("tags", "_t")}).drop("_e", "_l", "_t")


# Seeded choices: a digest of (seed, id) orders the rows, so every choice can be repeated, here and in SQL.


def hash_order(*ids: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[x.cast("string") for x in ids]))


def sample(rows: DataFrame, n: int, seed: int, by: Column | None = None) -> DataFrame:
    """n rows in seeded order; of the 3 * n greatest by `by`, if given."""
    pool = rows.orderBy(by.desc(), "seq").limit(3 * n) if by is not None else rows
    return pool.orderBy(hash_order(F.col("seq"), seed=seed), "seq").limit(n)


def from_distinct_namespaces(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in seeded order, one for each namespace at most."""
    first = F.row_number().over(Window.partitionBy("namespace").orderBy(hash_order(F.col("seq"), seed=seed), "seq"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n").orderBy(hash_order(F.col("seq"), seed=seed), "seq").limit(n)


def first_distractor(pairs: DataFrame, skill: DataFrame, seed: int) -> DataFrame:
    """For each resource the first HIGH neighbour (closed window) in seeded order that no skill holds."""
    near = mirror(pairs.select("seq_a", "seq_b", "sim")).filter((F.col("sim") >= HIGH) & (F.col("sim") <= NEAR_DUPLICATE)).join(skill.select(F.col("seq").alias("seq_b")), "seq_b", "left_anti")
    return near.groupBy("seq_a").agg(F.min_by(F.struct("seq_b", "sim"), F.struct(hash_order(F.col("seq_a"), F.col("seq_b"), seed=seed), F.col("seq_b"))).alias("d")).select("seq_a", "d.*")


def draw_model(resources: DataFrame, seed: int, draws: int = 50, gt: int = 4, other: int = 4) -> DataFrame:
    """(draw, ids): the first seeded draw of gt + other resources with three namespaces, an agent and an API among them."""
    kind = F.col("type").isin(*TYPE_SHARES)
    rows = resources.select("seq", "namespace", "type", kind.alias("gt"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    nth = F.row_number().over(Window.partitionBy("draw", "gt").orderBy(hash_order(F.col("draw"), F.col("seq"), seed=seed), "seq"))
    taken = rows.withColumn("n", nth).filter(F.col("n") <= F.when(F.col("gt"), gt).otherwise(other))
    sets = taken.groupBy("draw").agg(F.array_sort(F.collect_list("seq")).alias("ids"), F.count_distinct("namespace").alias("k"), F.bool_or(F.col("type") == "agent").alias("a"), F.bool_or(F.col("type") == "apiResource").alias("b"), F.count(F.lit(1)).alias("n"))
    return sets.filter(f"k >= 3 AND a AND b AND n = {gt + other}").orderBy("draw").limit(1).select("draw", "ids")


def max_to_skill(pairs: DataFrame, skills: DataFrame) -> DataFrame:
    """(skill, seq, sim): for resources outside a skill, the greatest similarity to a member. skills: (skill, ids[] of seq)."""
    member = skills.select("skill", F.explode("ids").alias("seq_a"))
    out = mirror(pairs.select("seq_a", "seq_b", "sim")).join(member, "seq_a").groupBy("skill", F.col("seq_b").alias("seq")).agg(F.max("sim").alias("sim"))
    return out.join(member.select("skill", F.col("seq_a").alias("seq")), ["skill", "seq"], "left_anti")
