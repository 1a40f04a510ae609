"""The loops against plain Python that goes the same way over lists."""

import random

from catalograph.operators import drivers

from .frames import SCHEMA, as_dicts, resource, scores

TIER = {"high": (0.5, 2.0, 3), "medium": (0.25, 0.5, 5), "low": (0.1, 0.25, 5)}


def rows_of(seed, n, kinds=("agent", "apiResource")):
    rng = random.Random(seed)
    words = ["order", "invoice", "supplier", "contract", "quality"]
    base = dict(text="order invoice supplier", local="OrderPlan", et=["E1", "E2"], lob=["L0"], tags=["T1"], industry=["I0"])
    out = []
    for i in range(n):
        r = dict(base) if rng.random() < 0.6 else dict(text=" ".join(rng.choices(words, k=4)), local=rng.choice(["OrderPlan", "HirePlan"]), et=rng.sample(["E1", "E2", "E3"], 2), lob=[f"L{rng.randrange(2)}"], tags=[f"T{rng.randrange(3)}"], industry=[])
        out.append(resource(i, rng.choice(["sap.sf", "workday.hcm", "sap.s4"]), kinds[i % len(kinds)], **r))
    return out


def log_of(df):
    return [r.asDict() for r in df.collect()]


def test_reduction_in_order(spark):
    rows = rows_of(8, 6)
    now = {r["seq"]: r for r in as_dicts(rows)}
    pairs = sorted(((s, a, b) for (a, b), s in scores(list(now.values()), list(now.values())).items() if a < b and s >= 0.75), reverse=True)
    pairs = [(a, b) for _, a, b in pairs]

    def rewrite(b, a, attempt):
        return None if attempt == 1 else {"tags": ["X"], "industry": ["Y"], "line_of_business": ["Z"], "local_id": "Unlike"} if b["seq"] % 2 else {"tags": b["tags"]}

    want = []
    for step, (a, b) in enumerate(pairs):
        if a not in now or b not in now:
            continue
        s = scores(list(now.values()), list(now.values()))
        high = lambda x, y: sum(1 for (p, q), v in s.items() if p == x and q != y and 0.5 <= v < 0.75)
        sim, ha, hb = s[(a, b)], high(a, b), high(b, a)
        if sim < 0.75:
            action = "skip"
        elif hb >= 3:
            action = "drop_b"
        elif ha >= 3:
            action = "drop_a"
        else:
            new = {**now[b], **rewrite(now[b], now[a], 2)}
            ok = scores([new, now[a]], list(now.values()))[(b, a)] < 0.75
            action = "rewrite_b" if ok else "drop_b"
            if ok:
                now[b] = new
        if action in ("drop_a", "drop_b"):
            del now[a if action == "drop_a" else b]
        want.append((step, a, b, sim if sim >= 0.5 else None, action))
    left, log = drivers.reduce_in_order(spark.createDataFrame(rows, SCHEMA), pairs, rewrite)
    got = [(r["step"], r["seq_a"], r["seq_b"], r["sim"], r["action"]) for r in log_of(log)]
    assert got == want and len(want) > 3 and len({w[4] for w in want}) > 1
    assert {r.seq: r.tags for r in left.collect()} == {i: r["tags"] for i, r in now.items()}


def _tier(s):
    return next((t for t, (lo, hi, _) in TIER.items() if lo <= s < hi), None)


def test_growth(spark):
    rows, systems, most = rows_of(5, 4, ("dataProduct", "agent", "apiResource", "apiResource")), ["sap.sf", "workday.hcm", "sap.s4"], 5
    clusters = {"sap.sf": ("sap.sf", "workday.hcm"), "workday.hcm": ("sap.sf", "workday.hcm"), "sap.s4": ("sap.ariba", "sap.s4")}

    def generate(profile):
        return None if profile["strategy_no"] == 99 else {"id": "x:y:New:v1", "local_id": "New", "text": "", "tags": profile.get("tags") or ["N"], "industry": [], "title": "n", "capabilities": [], "groups": [], "use_case_text": "", "enriched": False, "process_next": []}

    valid = lambda r: r["seq"] % 5 != 1 or len(r["line_of_business"]) > 0
    judge = lambda new, target, t, sim: target["seq"] != 2
    left, log = drivers.grow(spark.createDataFrame(rows, SCHEMA), systems, generate, valid, judge, rounds=1, most=most)

    now = as_dicts(rows)
    counts = {r["seq"]: dict.fromkeys(TIER, 0) for r in now}
    for (a, _), s in scores(now, now, False).items():
        if _tier(s):
            counts[a][_tier(s)] += 1
    gaps = [(r["seq"], t) for t in ("high", "medium") for r in now if counts[r["seq"]][t] < TIER[t][2]]
    want, next_seq, per = [], max(r["seq"] for r in now) + 1, {}
    for r in now:
        per[r["namespace"]] = per.get(r["namespace"], 0) + 1
    cap = -(-most // 3)
    for seq, t in gaps:
        if len(now) >= most:
            break
        s = scores(now, now, False)
        if sum(1 for (a, _), v in s.items() if a == seq and _tier(v) == t) >= TIER[t][2]:
            continue
        target = next(r for r in now if r["seq"] == seq)
        share = {"apiResource": 0.5, "agent": 0.25, "dataProduct": 0.25}
        kind = max(share, key=lambda k: share[k] - sum(r["type"] == k for r in now) / len(now))
        others = [x for x in systems if x != target["namespace"]]
        near = [x for x in others if (x in clusters[target["namespace"]]) == (t == "high")] or others
        order = sorted((x for x in [*near, *(o for o in others if o not in near)] if per.get(x, 0) < cap), key=lambda x: per.get(x, 0))
        if not order:
            continue
        ets, lob, tags = sorted(target["entity_types"]), target["line_of_business"], target["tags"]
        if t == "high":
            tries = [(ets, lob, tags), (ets, lob, [])]
        else:
            tries = [(ets[:2], x, []) for x in ([], ["Finance"], ["Operations"])] if len(ets) >= 2 else []
            tries += [(ets, x, []) for x in ([], ["Finance"], ["Operations"], ["Manufacturing"]) if x != lob] + [([e], lob, []) for e in ets]
        found = None
        for ns in order:
            for k, (e, x, g) in enumerate(tries):
                dummy = {"seq": -1, "id": "", "local_id": "Dummy", "type": kind, "namespace": ns, "entity_types": e, "line_of_business": x, "tags": g, "industry": [], "text": ""}
                if found is None and TIER[t][0] <= scores([target, dummy], now, False)[(seq, -1)] < TIER[t][1]:
                    found = (k, ns, e, x, g)
        if found is None:
            want.append(("no_profile", seq, t, None, None))
            continue
        new = {**generate({"strategy_no": found[0], "tags": found[4]}), "seq": next_seq, "type": kind, "namespace": found[1], "entity_types": found[2], "line_of_business": found[3]}
        if not valid(new):
            want.append(("rejected_c1", seq, t, None, None))
            continue
        s = scores([*now, new], now, False)
        sim, greatest = s[(next_seq, seq)], max(v for (a, _), v in s.items() if a == next_seq)
        outcome = "wrong_tier" if _tier(sim) != t else "near_duplicate" if greatest >= 0.75 else "accepted" if judge(new, target, t, sim) else "rejected_judge"
        want.append((outcome, seq, t, sim, next_seq if outcome == "accepted" else None))
        if outcome == "accepted":
            now.append(new)
            per[new["namespace"]] = per.get(new["namespace"], 0) + 1
            next_seq += 1
    got = [(r["outcome"], r["target"], r["tier"], r["sim"], r["seq"]) for r in log_of(log)]
    assert got == want and any(w[0] == "accepted" for w in want)
    assert {r.seq: (r.type, r.namespace, r.entity_types) for r in left.collect()} == {r["seq"]: (r["type"], r["namespace"], r["entity_types"]) for r in now}


def test_enrichment(spark):
    rows = rows_of(5, 2)
    now = as_dicts(rows)

    def act(target, t, candidate, attempt):
        if attempt % 4 == 3:
            return None
        tags = target["tags"] if t == "high" else []
        return {"entity_types": target["entity_types"], "line_of_business": target["line_of_business"] if t == "high" else ["Q"], "tags": tags}

    valid = lambda r: True
    judge = lambda new, target, t, sim: new["seq"] != 1 or t == "low"
    left, log = drivers.enrich(spark.createDataFrame(rows, SCHEMA), act, valid, judge, candidates=2, tries=1)
    want, skipped, changed = [], set(), set()
    while True:
        s = scores(now, now)
        goal = None
        for r in sorted(now, key=lambda r: r["seq"]):
            for t, (lo, hi, least) in TIER.items():
                if goal is None and (r["seq"], t) not in skipped and sum(1 for (a, _), v in s.items() if a == r["seq"] and lo <= v < hi) < least:
                    goal = (r["seq"], t)
        if goal is None:
            break
        seq, t = goal
        target, attempt, filled = next(r for r in now if r["seq"] == seq), 0, False
        pool = []
        for r in now:
            if r["seq"] != seq and (seq, r["seq"]) not in changed and _tier(s[(seq, r["seq"])]) != t:
                as_if = {**r, "entity_types": target["entity_types"], "line_of_business": target["line_of_business"], "tags": list(dict.fromkeys([*r["tags"], *target["tags"]]))}
                pool.append((-scores([target, as_if], now)[(seq, r["seq"])], r["seq"]))
        for _, c in sorted(pool)[:2]:
            old = next(r for r in now if r["seq"] == c)
            for _ in range(1):
                attempt += 1
                fields = act(target, t, old, attempt)
                if fields is None:
                    continue
                new = {**old, **fields}
                if not valid(new):
                    want.append(("rejected_c1", seq, t, c, attempt, None))
                    continue
                sim = scores([target, new], now)[(seq, c)]
                outcome = "wrong_tier" if _tier(sim) != t else "accepted" if judge(new, target, t, sim) else "rejected_judge"
                want.append((outcome, seq, t, c, attempt, sim))
                if outcome == "accepted":
                    now = [new if r["seq"] == c else r for r in now]
                    changed.add((seq, c))
                    filled = True
                    break
            if filled:
                break
        if not filled:
            want.append(("tier_skip", seq, t, None, None, None))
            skipped.add(goal)
    got = [(r["outcome"], r["target"], r["tier"], r["candidate"], r["attempt"], r["sim"]) for r in log_of(log)]
    assert got == want and {"tier_skip"} < {w[0] for w in want}
    assert {r.seq: r.tags for r in left.collect()} == {r["seq"]: r["tags"] for r in now}
