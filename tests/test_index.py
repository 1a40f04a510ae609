"""Versions of tables, and the stored index against one built anew."""

import pytest

from catalograph.operators import features, index
from catalograph.session import shared_folder
from catalograph.sources import snapshots

TEXT = "seq long, text string"


def rows(df):
    return sorted((r.seq, r.term, round(r.tf, 12), round(r.idf, 12), round(r.weight, 12)) for r in df.collect())


def test_an_index_kept_up_is_one_built_anew(spark):
    root = shared_folder(spark, "index")
    texts = {1: "order invoice order", 2: "invoice supplier", 3: None, 4: "", 5: "contract"}
    frame = lambda d: spark.createDataFrame(list(d.items()), TEXT)
    index.build(frame(texts), root)
    with pytest.raises(ValueError):
        index.build(frame(texts), root)
    gone = spark.createDataFrame([(2,), (77,)], "seq long")
    put = {3: "supplier quality", 5: None, 9: "order quality quality"}
    assert index.update(root, frame(put), gone) == 1
    now = {k: v for k, v in {**texts, **put}.items() if k != 2}
    assert rows(index.weights(spark, root)) == rows(features.tfidf(frame(now)))
    # The first version is still what it was; vectors are those of the kernels.
    assert rows(index.weights(spark, root, 0)) == rows(features.tfidf(frame(texts)))
    assert {r.seq: sorted(r.terms) for r in index.vectors(spark, root).collect()} == {r.seq: sorted(r.terms) for r in features.text_vectors(frame(now)).collect()}
    index.update(root, frame({}), frame(now).select("seq"))
    assert rows(index.weights(spark, root)) == []


def test_an_update_that_is_overtaken_starts_again(spark, monkeypatch):
    root = shared_folder(spark, "index")
    none = spark.createDataFrame([], "seq long")
    index.build(spark.createDataFrame([(1, "order")], TEXT), root)
    real, stale = snapshots.latest, [True]

    def late(s, at):
        if stale.pop() if stale else False:
            index.update(root, spark.createDataFrame([(2, "invoice")], TEXT), none)
            return 0
        return real(s, at)

    monkeypatch.setattr(snapshots, "latest", late)
    assert index.update(root, spark.createDataFrame([(3, "quality")], TEXT), none) == 2
    assert sorted(r.seq for r in index.tables(spark, root)[0].collect()) == [1, 2, 3]


def test_a_version_is_made_once(spark):
    root, schema = shared_folder(spark, "versions"), "id long"
    assert snapshots.latest(spark, root) == -1 and snapshots.read(spark, root, schema).count() == 0
    add = lambda n: spark.range(n, n + 1)
    assert snapshots.change(spark, root, schema, lambda t: t.unionByName(add(1))) == 0
    assert snapshots.change(spark, root, schema, lambda t: t.unionByName(add(2))) == 1
    assert not snapshots.commit(spark, root, 0, lambda at: add(9).write.parquet(at))
    assert sorted(r.id for r in snapshots.read(spark, root, schema).collect()) == [1, 2]
    assert [r.id for r in snapshots.read(spark, root, schema, 0).collect()] == [1]
    with pytest.raises(ZeroDivisionError):
        snapshots.commit(spark, root, 1, lambda at: 1 / 0)
    assert snapshots.latest(spark, root) == 1
