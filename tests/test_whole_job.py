"""Queries over whole tables and texts, against brute force on small tables."""

import os
import re

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalograph.operators.reduction import reduce_near_duplicates

from .frames import oracle, resource, tokens
from .tables import write

LANGS = {"en": "apiResource", "fr": "agent", "de": "dataProduct", "es": "entityType"}


@pytest.fixture
def long_texts(tmp_path):
    """Texts with one head of 70 words: they differ, and agree in part, only behind it."""
    head = " ".join(f"head{i}" for i in range(70))
    tails = ["red green blue", "red green blue", "red yellow", "pink yellow black", "white", ""]
    rows = [(i, f"{head} {t}", list(LANGS)[i % 3], "src1", i) for i, t in enumerate(tails)] + [(9, None, "en", "src1", 0), (13, " \t" + " ".join(f"tail{i}" for i in range(90)), "en", "src1", 3)]
    parts = [(i, f"cold widget{i % 3}") for i in range(200)]
    part = pa.table({"p_partkey": pa.array([p[0] for p in parts], pa.int64()), "p_name": [p[1] for p in parts]})
    return write(tmp_path, rows, part=part), rows, dict(parts)


def test_assets_hold_whole_texts(spark, long_texts):
    folder, rows, _ = long_texts
    got = {r.seq: r.tokens for r in entry.queries()["tokenize"](spark, folder).collect()}
    assert got == {i: tokens(text or "") for i, text, *_ in rows}


def test_pairs_use_words_behind_the_head(spark, long_texts):
    folder, rows, names = long_texts
    made = []
    for i, text, lang, _, n in rows:
        local = "".join(w.capitalize() for w in names[i].split())
        made.append(resource(i, f"sys{i % 7}", LANGS[lang], text or "", local, [f"E{i % 20}", f"F{i % 10}"], [f"L{i % 5}"], [f"T{i % 10}", f"U{n % 3}"], [f"I{i % 8}"] if i % 4 == 0 else []))
    want = oracle(made)
    got = {(r.seq_a, r.seq_b): r.sim for r in entry.queries()["pair_sim"](spark, folder).collect()}
    assert got and got == {k: want[k] for k in got}
    assert got[(0, 1)] != got.get((0, 3))


def _text(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def _kmeans(x, k):
    """(clusters, rounds) until no centre moves."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = x[:1]
    while len(c) < k:
        c = np.vstack([c, x[np.argmin((x @ c.T).max(axis=1))]])
    for r in range(1000):
        at = np.argmax(x @ c.T, axis=1)
        means = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
        new = means / np.linalg.norm(means, axis=1, keepdims=True)
        if np.abs(new - c).max() < 1e-12:
            return at.tolist(), r
        c = new


def test_kmeans_converges(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(300, 3)).round(6)
    pq.write_table(pa.table({"vec_id": pa.array(range(300), pa.int64()), "embedding": pa.array(x.tolist()), "label": ["a"] * 300}), tmp_path / "embeddings.parquet")
    want, rounds = _kmeans(x, 5)
    assert rounds > 20
    got = {r.id: r.cluster for r in entry.queries()["cosine_kmeans"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(300)] == want


def test_absence_by_whole_texts(spark, tmp_path):
    head = _text("head", 40)
    docs = [(0, head + " " + _text("one", 60)), (1, head + " " + _text("two", 60)), (2, head + " " + _text("two", 59)), (3, _text("apart", 50) + " " + _text("two", 60)), (4, head), (13, head + " end"), (50, None)]
    items = [(1, head + " " + _text("two", 60)), (2, _text("two", 60)), (3, _text("apart", 50) + " " + _text("two", 58))]
    folder = write(tmp_path, [(i, t, "en", "s", 1) for i, t in docs], items)
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    near = lambda a, b: bool(a | b) and len(a & b) / len(a | b) > 0.85
    want = {r: min((i for i, d in docs if near(words(t), words(d))), default=None) for r, t in [*items, *((100000 + i, t) for i, t in docs)]}
    assert {r.request_id: r.offender for r in entry.queries()["absent_requests"](spark, folder).collect()} == want


def test_id_lists_hold_all_cases(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    want = {}
    for r in entry.queries()["certification_cases"](spark, folder).select("case_id", "verdict").collect():
        want.setdefault(r.verdict, []).append(r.case_id)
    got = {r.verdict: r.case_ids for r in entry.queries()["certification_id_lists"](spark, folder).collect()}
    assert max(map(max, want.values())) >= 2000 and got == {k: sorted(v) for k, v in want.items()}


def test_profiles_for_all_medium_gaps(spark, sf):
    """A profile of both entity types alone is 0.25 away across namespaces; sys0 itself takes a later one."""
    need = {r.seq: r.namespace for r in entry.queries()["tier_counts"](spark, sf).filter("medium_needed > 0").collect()}
    got = {r.seq: r for r in entry.queries()["fitting_profiles"](spark, sf).collect()}
    assert need and set(got) == set(need)
    assert all((r.strategy_no == 0 and r.sim == 0.25) == (need[i] != "sys0") for i, r in got.items())


def test_reduction_of_many_copies(spark):
    """140 equal resources in a few rounds: one of them stays, by pairs that share no resource."""
    n, rounds = 140, []

    def pairs_of(df):
        rounds.append(1)
        a, b = df.selectExpr("seq AS seq_a"), df.selectExpr("seq AS seq_b")
        return a.join(b, F.col("seq_a") < F.col("seq_b")).withColumn("sim", F.when(F.col("seq_b") < n, 0.9).otherwise(0.1))

    def cut(df):
        return spark.createDataFrame(df.collect(), df.schema)

    left, decisions = reduce_near_duplicates(spark.range(n + 2).withColumnRenamed("id", "seq"), pairs_of, cut=cut)
    assert sorted(r.seq for r in left.collect()) == [0, n, n + 1]
    made = decisions.collect()
    assert len(made) == n - 1 and len(rounds) < 60
    for r in {d.round for d in made}:
        ends = [x for d in made if d.round == r for x in (d.seq_a, d.seq_b)]
        assert len(ends) == len(set(ends))


def test_reduction_goes_on_after_the_rounds_of_rewriting(spark):
    pairs = lambda df: df.selectExpr("seq AS seq_a").join(df.selectExpr("seq AS seq_b"), F.col("seq_a") < F.col("seq_b")).withColumn("sim", F.lit(0.9))
    left, _ = reduce_near_duplicates(spark.range(6).withColumnRenamed("id", "seq"), pairs, rounds=1, cut=lambda df: spark.createDataFrame(df.collect(), df.schema))
    assert left.count() == 1
