"""The curve of convergence looks only at blocks that may hold a better neighbour."""

from catalograph.operators import ambiguity, blocks, features, reduction
from catalograph.sources.fixtures import assets


def test_convergence_does_not_score_all_pairs(spark, sf, monkeypatch):
    s = features.scored(assets(spark, sf)).selectExpr("*", "cast(seq % 2 AS int) AS round")
    want = ambiguity.mean_top_ambiguity(ambiguity.ranked_neighbours(blocks.block_neighbours(s, 5, 0.25, use_text=False))).first()

    def all_pairs(*a, **k):
        raise AssertionError("all pairs were asked for")

    monkeypatch.setattr(reduction, "block_neighbours", all_pairs, raising=False)
    got = {r["round"]: r for r in reduction.convergence(s, [0, 1]).collect()}
    assert (got[1].mean_ambiguity, got[1].n) == (want.mean_ambiguity, want.n)
