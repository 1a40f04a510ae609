"""First sets above a bound: exact against brute force, in several rounds, and no words for each pair of near copies."""

import random

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
import pytest

from catalograph.operators import wordsets as W
from catalograph.operators.validate import absent_everywhere

from .tables import write


def _shuffled(spark):
    """Bytes that the session has written to shuffle files so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_near_copies_do_not_meet_in_full(spark, tmp_path):
    """200 texts that are all above the bound of each other: each needs the words of a few others, not of all."""
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(400)]
    docs = [(i, " ".join(rng.sample([*base, f"own{i}"], 401)), "en", "s", 1) for i in range(200)]
    folder = write(tmp_path, docs, [(1, "apart")])
    held = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for c in held:
            spark.conf.set(c, "-1")
        before = _shuffled(spark)
        got = {r.request_id: r.offender for r in entry.queries()["absent_requests"](spark, folder).collect()}
        after = _shuffled(spark)
    finally:
        for c, v in held.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert got == {1: None, **{100000 + i: 0 for i in range(200)}}
    assert after - before < 12 * sum(len(d[1]) for d in docs)


def _near(a, b, above):
    return bool(a) and bool(b) and len(a & b) / len(a | b) > above


@pytest.mark.parametrize("above", [0.6, 0.85])
def test_rounds_are_exact(spark, above):
    """Sets just above and below the bound, one partner a round, few and many words, copies, ids twice, null and empty."""
    rng = random.Random(int(above * 100))
    sets = []
    for _ in range(25):
        size = rng.choice([1, 2, 7, 20, 60, 400])
        base = rng.sample(range(1500), size)
        for _ in range(12):
            gone = int(size * rng.choice([0, 0.04, 0.08, 0.12]))
            sets.append({str(w) for w in rng.sample(base, size - gone) + rng.sample(range(1500, 3000), rng.randrange(gone + 1))})
    sets += [set(), sets[5], sets[40]]
    rng.shuffle(sets)
    rows = [(i, i if i % 5 else None, True, sorted(s)) for i, s in enumerate(sets)] + [(None, 500, True, ["x"]), (7, 501, True, None), (None, 502, False, sorted(sets[0]))]
    known = [(q, set(w or ())) for _, q, _, w in rows if q is not None]
    want = {}
    for r, _, asks, w in rows:
        if asks and r is not None:
            want.setdefault(r, []).extend(q for q, s in known if _near(set(w or ()), s, above))
    df = spark.createDataFrame(rows, "request_id long, seq long, asks boolean, words array<string>")
    for most in (1, 8):
        got = W.first_above(df, above, most).collect()
        assert len(got) == len(rows) - 1
        assert {r.request_id: r.offender for r in got if r.request_id is not None} == {r: min(q, default=None) for r, q in want.items()}
        assert [r.offender for r in got if r.request_id is None] == [None]


def test_requests_apart_from_resources(spark):
    requests = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", None)], "request_id string, words array<string>")
    resources = spark.createDataFrame([(3, ["y", "x"]), (2, ["x", "y"]), (1, ["z"])], "seq long, words array<string>")
    assert {r.request_id: r.offender for r in absent_everywhere(requests, resources).collect()} == {"a": 2, "b": None, "c": None}


def test_bitmaps_bound_the_difference():
    """Bits of two bitmaps differ in no more places than the sets do, whatever their widths."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [rng.choice(len(words), k, replace=False) for k in (1, 100, 250, 260, 300, 900, 1100, 1100)]
    sets.append(np.append(sets[-1][5:], sets[0]))
    k = np.array([len(s) for s in sets])
    maps = W._Maps(W._parities(np.repeat(np.arange(len(k)), k), np.concatenate([words[s] for s in sets]), W._bits(k)).to_pylist())
    a, b = np.divmod(np.arange(len(k) ** 2), len(k))
    apart = np.array([len(set(sets[i]) ^ set(sets[j])) for i, j in zip(a, b)])
    differ = maps.differ(a, b)
    assert len(set(maps.width)) > 2 and (differ <= apart).all() and differ[apart > 800].min() > 40
    assert isinstance(W._parities(np.zeros(1, int), words[:1], np.array([128])), pa.BinaryArray)
