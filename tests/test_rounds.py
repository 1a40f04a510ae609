"""The reduction in rounds against its loop, pair by pair."""

import random

import pytest

from catalograph.operators.rounds import reduce_in_rounds


def loop(pairs, need):
    gone, out = set(), []
    for sim, a, b in sorted((-s, a, b) for a, b, s in pairs if s >= 0.75):
        if a in gone or b in gone:
            continue
        high = lambda x: sum(1 for p, q, s in pairs if 0.5 <= s < 0.75 and x in (p, q) and (q if x == p else p) not in gone)
        action = "drop_a" if high(b) < need <= high(a) else "drop_b"
        gone.add(a if action == "drop_a" else b)
        out.append((a, b, -sim, action))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_give_the_result_of_the_loop(spark, seed):
    rng = random.Random(seed)
    n = 30
    pairs = [(a, b, round(rng.choice([0.4, 0.5, 0.6, 0.74, 0.75, 0.8, 0.8, 0.9, 1.0]), 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.1, 0.3, 0.15, 0.6)[seed]]
    got, rounds = reduce_in_rounds(spark.createDataFrame(pairs, "seq_a long, seq_b long, sim double"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == loop(pairs, 3) and rounds >= 1


def test_a_pair_before_the_drop_of_its_first_end_counts(spark):
    """(0, 2) is sure and drops 2 at once; (2, 5) comes before it but has to wait for (1, 5), which drops 1."""
    pairs = [(1, 5, 0.95), (2, 5, 0.9), (0, 2, 0.8), (1, 10, 0.6), (1, 11, 0.6), (1, 12, 0.6)]
    got, _ = reduce_in_rounds(spark.createDataFrame(pairs, "seq_a long, seq_b long, sim double"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == loop(pairs, 3) == [(0, 2, 0.8, "drop_b"), (1, 5, 0.95, "drop_a"), (2, 5, 0.9, "drop_b")]


def test_without_near_duplicates(spark):
    got, rounds = reduce_in_rounds(spark.createDataFrame([(1, 2, 0.6)], "seq_a long, seq_b long, sim double"))
    assert got.collect() == [] and rounds == 0


def test_copies_of_one_resource(spark):
    pairs = [(a, b, 1.0) for a in range(25) for b in range(a + 1, 25)]
    got, rounds = reduce_in_rounds(spark.createDataFrame(pairs, "seq_a long, seq_b long, sim double"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == loop(pairs, 3)
    assert rounds == 1
