"""The loops that build a catalogue, step by step in their own order: near-duplicate reduction, growth, enrichment.

What a model decides is a hook; everything else is scored by blocks, the resources of one step against all others. A loop is
sequential by definition: each step sees what the steps before it changed. The driver holds the changed resources and the log, no
more; the catalogue stays a table. Resources are rows with a unique seq, which is also their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tier
from ..schema import DOMAIN_CLUSTERS, GROUND_TRUTH_TYPES, NEAR_DUPLICATE, TIER_MINIMUM, TIERS, TYPE_SHARES
from ..session import shared_folder, written
from .ambiguity import tier_totals, tier_windows
from .blocks import block_counts, block_pairs, with_ends
from .features import scored, text_vectors
from .pairs import mirror
from .reduction import aligned, candidate_profiles, decide
from .upkeep import updated_counts

HIGH, MEDIUM, LOW = (low for _, low in TIERS)
_UPPER = {"high": 2.0, "medium": HIGH, "low": MEDIUM}
#: Changes that the driver holds before the catalogue is written anew.
HELD = 500


class Catalogue:
    """A table of resources with the changes that a loop has made to it."""

    def __init__(self, resources: DataFrame):
        self.base, self.rows, self.gone = resources, {}, set()

    def now(self) -> DataFrame:
        if len(self.rows) + len(self.gone) > HELD:
            path = shared_folder(self.base.sparkSession, "catalogue")
            self._now().write.parquet(path)
            self.base, self.rows, self.gone = self.base.sparkSession.read.schema(self.base.schema).parquet(path), {}, set()
        return self._now()

    def _now(self) -> DataFrame:
        old = [*self.gone, *self.rows]
        out = self.base.filter(~F.col("seq").isin(old)) if old else self.base
        if not self.rows:
            return out
        return out.unionByName(out.sparkSession.createDataFrame([[r.get(c) for c in self.base.columns] for r in self.rows.values()], self.base.schema))

    def row(self, seq: int) -> dict | None:
        if seq in self.gone:
            return None
        if seq in self.rows:
            return dict(self.rows[seq])
        found = self.base.filter(F.col("seq") == seq).first()
        return found.asDict() if found else None

    def put(self, row: dict) -> None:
        self.rows[row["seq"]] = row
        self.gone.discard(row["seq"])

    def remove(self, seq: int) -> None:
        self.rows.pop(seq, None)
        self.gone.add(seq)

    def with_row(self, row: dict) -> DataFrame:
        """The present resources with one of them as `row` has it, or with `row` added."""
        new = self.base.sparkSession.createDataFrame([[row.get(c) for c in self.base.columns]], self.base.schema)
        return self.now().filter(F.col("seq") != row["seq"]).unionByName(new)


def _log(resources: DataFrame, events: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return resources.sparkSession.createDataFrame([[e.get(n) for n in names] for e in events], schema)


def _inside(sim: float, tier_name: str) -> bool:
    return dict(TIERS)[tier_name] <= sim < _UPPER[tier_name]


# Near-duplicate reduction.


def reduce_in_order(resources: DataFrame, pairs: Iterable[tuple[int, int]], rewrite: Callable[[dict, dict, int], dict | None] | None = None, valid: Callable[[dict], bool] = lambda r: True, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(resources left, decisions (step, seq_a, seq_b, sim, high_a, high_b, action)) of the pairs in the order given.

    A pair with a removed end is passed over; one that scores below the threshold by now is skipped. Else B goes if it keeps
    enough HIGH neighbours without A (or both ends do), A if only A does; otherwise rewrite(b, a, attempt) may return changed
    fields of B, which stay if they are valid and bring the pair below the threshold, and B goes after `tries` attempts.
    """
    at, events = Catalogue(resources), []
    for step, (a, b) in enumerate(pairs):
        if at.row(a) is None or at.row(b) is None:
            continue
        now = scored(at.now())
        near = block_pairs(now, least=HIGH, left=now.filter(F.col("seq").isin(a, b)))
        below = F.col("sim") < NEAR_DUPLICATE
        one = lambda x, y: F.count_if((F.col("seq_a") == x) & (F.col("seq_b") != y) & below)
        got = near.agg(F.max(F.when((F.col("seq_a") == a) & (F.col("seq_b") == b), F.col("sim"))).alias("sim"), one(a, b).alias("high_a"), one(b, a).alias("high_b")).withColumn("action", decide(F.col("high_a"), F.col("high_b"))).first()
        event = {"step": step, "seq_a": a, "seq_b": b, "sim": got["sim"], "high_a": got["high_a"], "high_b": got["high_b"], "action": got["action"]}
        if got["sim"] is None or got["sim"] < NEAR_DUPLICATE:
            event["action"] = "skip"
        elif got["action"] == "rewrite_b":
            new = _rewritten(at, a, b, rewrite, valid, tries) if rewrite else None
            if new:
                at.put(new)
            else:
                event["action"] = "drop_b"
                at.remove(b)
        else:
            at.remove(a if got["action"] == "drop_a" else b)
        events.append(event)
    return at.now(), _log(resources, events, "step int, seq_a long, seq_b long, sim double, high_a long, high_b long, action string")


def _rewritten(at: Catalogue, a: int, b: int, rewrite: Callable, valid: Callable, tries: int) -> dict | None:
    """B as rewritten. Its text keeps the weights of the catalogue, as an index by id does that is not built anew."""
    old, reference, corpus = at.row(b), at.row(a), scored(at.now())
    for attempt in range(1, tries + 1):
        fields = rewrite(dict(old), dict(reference), attempt)
        if fields is None:
            continue
        new = {**old, **fields, "seq": b}
        two = scored(at.with_row(new)).filter(F.col("seq").isin(a, b))
        sim = block_pairs(two, left=two.filter(F.col("seq") == b), every=True, corpus=corpus).first()["sim"]
        if sim < NEAR_DUPLICATE and valid(new):
            return new
    return None


# Growth.


def _namespaces(target: str, systems: list[str], tier_name: str, counts: dict[str, int], cap: int) -> list[str]:
    """Where a neighbour may go: for HIGH systems of the target's cluster, else those outside it (all others if none), then the rest; below the cap, the smallest first."""
    others = [s for s in systems if s != target]
    cluster = next((members for _, members in DOMAIN_CLUSTERS if target in members), ())
    near = [s for s in others if (s in cluster) == (tier_name == "high")] or others
    order = [s for s in [*near, *(s for s in others if s not in near)] if counts.get(s, 0) < cap]
    return sorted(order, key=lambda s: counts.get(s, 0))


def grow(
    resources: DataFrame,
    systems: list[str],
    generate: Callable[[dict], dict | None],
    valid: Callable[[dict], bool] = lambda r: True,
    judge: Callable[[dict, dict, str, float], bool] = lambda new, target, tier_name, sim: True,
    rounds: int = 20,
    most: int = 300,
    bridges: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(resources, log (round, action, outcome, target, tier, strategy_no, sim, seq)): rounds of filling HIGH, then MEDIUM gaps by the text-free metric.

    For each gap that is still open: type and system by balance, the first attribute profile that lands in the tier, generate(profile) for
    the resource (its entity types and lines of business stay those of the profile), then the gates valid, tier, near-duplicate, judge.
    """
    at, events = Catalogue(resources), []
    kinds = F.col("type").isin(*GROUND_TRUTH_TYPES)
    counts = None
    cap = -(-most // len(systems))
    next_seq = (resources.agg(F.max("seq")).first()[0] or 0) + 1
    for rnd in range(1, rounds + 1):
        held = scored(at.now()).filter(kinds)
        by_system = {r.namespace: r.n for r in held.groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = sum(by_system.values())
        if n >= most:
            break
        if counts is None:
            # Counts are kept up by what each round adds; rarities that shift later do not change them.
            counts = _directed(with_ends(block_pairs(held, use_text=False, least=LOW), held))
        added = 0
        for gap in _open_gaps(counts, held).toLocalIterator():
            if n + added >= most:
                break
            event = {"round": rnd, "action": "create", "target": gap.seq, "tier": gap.tier}
            target, now = at.row(gap.seq), scored(at.now()).filter(kinds)
            mine = block_pairs(now, use_text=False, least=dict(TIERS)[gap.tier], left=now.filter(F.col("seq") == gap.seq))
            if mine.filter(F.col("sim") < _UPPER[gap.tier]).count() >= TIER_MINIMUM[gap.tier]:
                continue
            kind = _next_type(now)
            order = _namespaces(target["namespace"], systems, gap.tier, by_system, cap)
            if not order:
                continue
            profile = _profile(now, target, gap.tier, kind, order, bridges)
            if profile is None:
                events.append(event | {"action": "skip", "outcome": "no_profile"})
                continue
            made = generate(dict(profile))
            if made is None:
                continue
            new = {**made, "seq": next_seq, "type": kind, "namespace": profile["namespace"], "entity_types": profile["entity_types"], "line_of_business": profile["line_of_business"] or made.get("line_of_business") or []}
            if not valid(new):
                events.append(event | {"outcome": "rejected_c1"})
                continue
            probe = scored(at.with_row(new)).filter(kinds)
            scores = block_pairs(probe, use_text=False, left=probe.filter(F.col("seq") == next_seq), every=True, corpus=now)
            got = scores.agg(F.max(F.when(F.col("seq_b") == gap.seq, F.col("sim"))).alias("sim"), F.max("sim").alias("greatest")).first()
            event |= {"strategy_no": profile["strategy_no"], "sim": got["sim"]}
            if not _inside(got["sim"], gap.tier):
                events.append(event | {"outcome": "wrong_tier"})
            elif got["greatest"] >= NEAR_DUPLICATE:
                events.append(event | {"outcome": "near_duplicate"})
            elif not judge(new, target, gap.tier, got["sim"]):
                events.append(event | {"outcome": "rejected_judge"})
            else:
                at.put(new)
                counts = counts.unionByName(_added(at, next_seq, kinds))
                events.append(event | {"outcome": "accepted", "seq": next_seq})
                by_system[new["namespace"]] = by_system.get(new["namespace"], 0) + 1
                next_seq, added = next_seq + 1, added + 1
    return at.now(), _log(resources, events, "round int, action string, outcome string, target long, tier string, strategy_no int, sim double, seq long")


def _directed(pairs: DataFrame) -> DataFrame:
    """(seq, tier) of both ends of pairs in a tier, as a table of its own."""
    rows = mirror(pairs.select("seq_a", "seq_b", "sim")).select(F.col("seq_a").alias("seq"), tier(F.col("sim")).alias("tier")).filter("tier IS NOT NULL")
    path = shared_folder(pairs.sparkSession, "tiers")
    rows.write.parquet(path)
    return pairs.sparkSession.read.schema("seq long, tier string").parquet(path)


def _added(at: Catalogue, seq: int, kinds) -> DataFrame:
    now = scored(at.now()).filter(kinds)
    return _directed(block_pairs(now, use_text=False, least=LOW, left=now.filter(F.col("seq") == seq)))


def _open_gaps(counts: DataFrame, held: DataFrame) -> DataFrame:
    """(seq, tier) of what is missing, all HIGH gaps before the MEDIUM ones, each by seq."""
    have = counts.groupBy("seq").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium")])
    lacks = lambda i, t: F.when(F.coalesce(t, F.lit(0)) < TIER_MINIMUM[t], F.struct(F.lit(i).alias("o"), F.lit(t).alias("tier")))
    rows = held.select("seq").join(have, "seq", "left").select("seq", F.explode(F.array_compact(F.array(lacks(0, "high"), lacks(1, "medium")))).alias("g"))
    return rows.orderBy("g.o", "seq").select("seq", "g.tier")


def _next_type(resources: DataFrame) -> str:
    """The type furthest below its share; ties in the order of the shares."""
    have = {r["type"]: r.n for r in resources.groupBy("type").agg(F.count(F.lit(1)).alias("n")).filter(F.col("type").isin(*TYPE_SHARES)).collect()}
    total = max(1, sum(have.values()))
    return max(TYPE_SHARES, key=lambda t: TYPE_SHARES[t] - have.get(t, 0) / total)


def _profile(now: DataFrame, target: dict, tier_name: str, kind: str, order: list[str], bridges: tuple[str, ...]) -> dict | None:
    """The first profile in the tier, systems in order, strategies in order within one: all of them in one scoring."""
    spark = now.sparkSession
    own = now.filter(F.col("seq") == target["seq"])
    places = spark.createDataFrame(list(enumerate(order)), "place int, new_namespace string")
    wanted = own.crossJoin(F.broadcast(places)).withColumn("new_type", F.lit(kind))
    tries = None
    for place, _ in enumerate(order):
        part = candidate_profiles(wanted.filter(F.col("place") == place), tier_name, bridges=bridges).withColumn("place", F.lit(place))
        tries = part if tries is None else tries.unionByName(part)
    none = F.array().cast("array<string>")
    dummies = tries.select((-1 - F.col("place") * 1000 - F.col("strategy_no")).cast("long").alias("seq"), "namespace", "type", "entity_types", "line_of_business", "tags", none.alias("industry"), F.array(F.lit("dummy")).alias("local_tokens"))
    cols = dummies.columns
    probe = own.select(*cols).unionByName(dummies)
    found = block_pairs(probe, use_text=False, left=own.select("seq"), every=True, corpus=now).filter((F.col("sim") >= dict(TIERS)[tier_name]) & (F.col("sim") < _UPPER[tier_name]))
    best = found.orderBy(F.col("seq_b").desc()).limit(1).join(dummies, F.col("seq_b") == F.col("seq")).select("namespace", "type", "entity_types", "line_of_business", "tags", "sim", (-1 - F.col("seq")).alias("rank")).first()
    return None if best is None else {**best.asDict(), "strategy_no": best["rank"] % 1000}


# Enrichment.


def enrich(
    resources: DataFrame,
    act: Callable[[dict, str, dict, int], dict | None],
    valid: Callable[[dict], bool] = lambda r: True,
    judge: Callable[[dict, dict, str, float], bool] = lambda new, target, tier_name, sim: True,
    candidates: int = 5,
    tries: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(resources, log (action, outcome, target, tier, candidate, attempt, sim)): candidates are changed until every tier of every ground-truth resource is met or skipped.

    Each pass takes the first unmet tier of the first resource. Candidates come by their score as if aligned to the target, without those in
    the tier, tried, or changed for this target before; act(target, tier, candidate, attempt) returns changed fields. A tier that
    `candidates` candidates do not fill is skipped for good. A changed resource is scored with the text that the catalogue has of it.
    All pairs are scored once, at the start; an accepted change takes its old counts away and adds its new ones, unless it changes a text.
    """
    at, events, skipped, changed = Catalogue(resources), [], set(), set()
    kinds = F.col("type").isin(*GROUND_TRUTH_TYPES)
    texts, near = _counted(scored(at.now()))
    while True:
        now = scored(at.now())
        counts = tier_totals(near, now).filter(kinds & ~F.col("done"))
        # Open tiers in order; as many are passed over as were skipped, so that many rows at most are needed.
        needs = F.array(*[F.when(F.col(f"{t}_needed") > 0, F.struct(F.lit(i).alias("o"), F.lit(t).alias("tier"))) for i, t in enumerate(TIER_MINIMUM)])
        rows = counts.select("seq", F.explode(F.array_compact(needs)).alias("t")).select("seq", "t.*").orderBy("seq", "o").limit(len(skipped) + 1).collect()
        goal = next(((r.seq, r.tier) for r in rows if (r.seq, r.tier) not in skipped), None)
        if goal is None:
            break
        seq, tier_name = goal
        event = {"action": "modify", "target": seq, "tier": tier_name}
        target, tried, attempt, filled = at.row(seq), set(), 0, False
        order = _potential(now, kinds, seq, tier_name, [c for t, c in changed if t == seq], candidates, texts)
        for candidate in order:
            tried.add(candidate)
            old = at.row(candidate)
            for _ in range(tries):
                attempt += 1
                fields = act(dict(target), tier_name, dict(old), attempt)
                if fields is None:
                    continue
                new = {**old, **fields, "seq": candidate}
                step = event | {"candidate": candidate, "attempt": attempt}
                if not valid(new):
                    events.append(step | {"outcome": "rejected_c1"})
                    continue
                two = scored(at.with_row(new)).filter(F.col("seq").isin(seq, candidate))
                sim = block_pairs(two, left=two.filter(F.col("seq") == seq), every=True, corpus=now, texts=texts).first()["sim"]
                if not _inside(sim, tier_name):
                    events.append(step | {"outcome": "wrong_tier", "sim": sim})
                elif not judge(new, target, tier_name, sim):
                    events.append(step | {"outcome": "rejected_judge", "sim": sim})
                else:
                    events.append(step | {"outcome": "accepted", "sim": sim})
                    at.put(new)
                    after = scored(at.now())
                    if new.get("text") == old.get("text"):
                        near = written(updated_counts(near, now, after, texts), "tiers")
                    else:
                        texts, near = _counted(after)
                    changed.add((seq, candidate))
                    filled = True
                    break
            if filled:
                break
        if not filled:
            events.append(event | {"action": "skip", "outcome": "tier_skip"})
            skipped.add(goal)
    return at.now(), _log(resources, events, "action string, outcome string, target long, tier string, candidate long, attempt int, sim double")


def _counted(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text vectors, counts by namespace and tier) of all resources, as tables."""
    texts = written(text_vectors(now), "texts")
    return texts, written(block_counts(now, tier_windows(), "namespace", texts=texts), "tiers")


def _potential(now: DataFrame, kinds, seq: int, tier_name: str, without: list[int], n: int, texts: DataFrame) -> list[int]:
    """The n candidates with the greatest score as if aligned to the target, ties by seq."""
    own = now.filter(F.col("seq") == seq)
    actual = block_pairs(now, left=own, least=LOW, texts=texts).select(F.col("seq_b").alias("seq"), tier(F.col("sim")).alias("tier")).filter(F.col("tier") == tier_name)
    pool = now.filter(kinds & (F.col("seq") != seq))
    pool = (pool.filter(~F.col("seq").isin(without)) if without else pool).join(actual.select("seq"), "seq", "left_anti")
    as_if = aligned(pool.withColumn("target_seq", F.lit(seq).cast("long")), now).select(*now.columns)
    found = block_pairs(as_if.unionByName(own), left=own, every=True, corpus=now, texts=texts)
    return [r.seq_b for r in found.orderBy(F.col("sim").desc(), "seq_b").limit(n).collect()]
