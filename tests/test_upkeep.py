"""Counts kept up by signed changes against counting anew."""

import pytest
from pyspark.sql import functions as F

from catalograph.operators import ambiguity, blocks, features, upkeep
from catalograph.sources.fixtures import assets


@pytest.fixture(scope="module")
def resources(spark, sf):
    return features.scored(assets(spark, sf)).cache()


def rows(df):
    return sorted((r.seq, str(r.label), r.high, r.medium, r.low) for r in df.collect())


def check(before, after, monkeypatch, block=96):
    monkeypatch.setattr(blocks, "BLOCK", block)
    texts = features.text_vectors(before.unionByName(after.join(before, "seq", "left_anti")))
    near = blocks.block_counts(before, ambiguity.tier_windows(), "namespace", texts=texts)
    got = rows(upkeep.updated_counts(near, before, after, texts))
    assert got == rows(blocks.block_counts(after, ambiguity.tier_windows(), "namespace", texts=texts))
    return got, rows(near)


def test_a_change_moves_all_that_share_its_types(resources, monkeypatch):
    hit = F.col("seq") % 40 == 3
    after = resources.withColumns({"entity_types": F.when(hit, F.array(F.lit("E1"), F.lit("Q"))).otherwise(F.col("entity_types")), "namespace": F.when(hit, F.lit(None)).otherwise(F.col("namespace"))})
    n, total = upkeep.moved(resources, after).count(), resources.count()
    assert resources.filter(hit).count() < n < total
    got, old = check(resources, after, monkeypatch)
    assert got != old


def test_resources_that_come_and_go(resources, monkeypatch):
    new = resources.limit(3).withColumn("seq", F.col("seq") + 100_000)
    check(resources, resources.filter("seq % 25 <> 4").unionByName(new), monkeypatch)


def test_nothing_and_everything_changed(resources, monkeypatch):
    got, old = check(resources, resources, monkeypatch)
    assert got == old
    check(resources, resources.withColumn("tags", F.array(F.lit("same"))), monkeypatch)
    assert upkeep.moved(resources.filter("false"), resources.filter("false")).count() == 0


def test_texts_that_shift_have_to_be_given(resources):
    near = blocks.block_counts(resources, ambiguity.tier_windows(), "namespace")
    with pytest.raises(ValueError):
        upkeep.updated_counts(near, resources, resources.filter("seq > 5"))
