"""Kernels and rankings against plain Python, the dense plan, and each other."""

import random

import pytest
from pyspark.sql import functions as F

from catalograph.functions import arrays as A
from catalograph.functions import text as X
from catalograph.functions.compat import cache_key, python_round
from catalograph.operators import ambiguity, blocks, disambiguation, features, pairs, reduction
from catalograph.plans.landscape import Landscape

from .frames import SCHEMA, oracle, resource


def random_rows(n, seed):
    rng = random.Random(seed)
    pick = lambda c, k, m: [f"{c}{rng.randrange(m)}" for _ in range(rng.randrange(k + 1))]
    words = ["order", "invoice", "supplier", "contract", "BOM", "hire", "leave", "plan", "of", "the", "quality"]
    rows = []
    for i in range(n):
        rich = rng.random() < 0.4
        rows.append(resource(i, rng.choice("abc"), rng.choice(["agent", "apiResource", "dataProduct", "entityType"]), " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["", "OrderPlan", "BOMCompliance", "HirePlan"]), pick("E", 3, 9), pick("L", 1, 4), pick("T", 3, 6), pick("I", 1, 3), pick("C", 2, 4) if rich else (), pick("G", 1, 3) if rich else (), " ".join(rng.choices(words, k=5)) if rich else ""))
    return rows


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = random_rows(60, 4)
    return rows, features.scored(spark.createDataFrame(rows, SCHEMA)).persist()


def table(df, value="sim"):
    return {(r.seq_a, r.seq_b): r[value] for r in df.select("seq_a", "seq_b", value).collect()}


_BASE = {}


def base(s):
    """The pair table, persisted once."""
    if id(s) not in _BASE:
        _BASE[id(s)] = pairs.sparse_pairs(s).persist()
    return _BASE[id(s)]


def with_background(sparse, rows):
    """Sparse scores, pairs that share nothing added."""
    kind = {r[0]: (r[2], r[3]) for r in rows}
    out = {}
    for (a, b) in oracle(rows):
        same_ns, same_type = kind[a][0] == kind[b][0], kind[a][1] == kind[b][1]
        out[(a, b)] = sparse.get((a, b), 0.0 if same_ns else 0.0833 if same_type else 0.0417)
    return out


def test_sparse_equals_oracle_and_dense(catalogue):
    rows, s = catalogue
    want = oracle(rows)
    sparse, dense = table(pairs.sparse_pairs(s)), table(pairs.dense_pairs(s))
    assert dense == want
    assert with_background(sparse, rows) == want


def test_extended_metric(catalogue):
    rows, s = catalogue
    df = pairs.sparse_pairs(s, extended=True)
    got, want = table(df, "sim_extended"), oracle(rows, extended=True)
    assert got and all(want[k] == v for k, v in got.items())
    assert df.filter("active = 0 AND sim <> sim_extended").count() == 0
    avg = {r.subset: r for r in disambiguation.average_similarity(df, s).collect()}
    on = {r[0] for r in rows if r[13] and r[3] != "entityType"}
    full = oracle(rows)
    both = [k for k in full if k[0] in on and k[1] in on]
    assert avg["all"].n == len(both)
    assert abs(avg["all"].mean - sum(full[k] for k in both) / len(both)) < 2e-4
    assert abs(avg["all"].mean_extended - sum(want[k] for k in both) / len(both)) < 2e-4


def test_blocks_equal_sparse(catalogue, monkeypatch):
    _, s = catalogue
    for size in (1024, 7):
        monkeypatch.setattr(blocks, "BLOCK", size)
        assert table(blocks.block_pairs(s)) == table(pairs.sparse_pairs(s))
        got = blocks.block_pairs(s, extended=True)
        want = pairs.sparse_pairs(s, extended=True)
        assert table(got, "sim_extended") == table(want, "sim_extended") and table(got, "active") == table(want, "active")
    assert table(blocks.block_pairs(s, use_text=False, least=0.3)) == table(pairs.sparse_pairs(s, use_text=False).filter("sim >= 0.3"))


def test_within_type_keeps_near_duplicates(catalogue):
    _, s = catalogue
    a, b = table(pairs.sparse_pairs(s).filter("sim >= 0.6 AND type_a = type_b")), table(pairs.sparse_pairs(s, within_type=True).filter("sim >= 0.6"))
    assert a == b


def test_text_free_is_a_lower_bound(catalogue):
    _, s = catalogue
    fast, full = table(pairs.sparse_pairs(s, use_text=False)), table(pairs.sparse_pairs(s))
    assert all(v <= full[k] + 1e-4 for k, v in fast.items())


@pytest.mark.parametrize("k", [1, 5, 12])
def test_completed_neighbours(catalogue, k):
    rows, s = catalogue
    full = oracle(rows)
    want = {}
    for (a, b), v in full.items():
        want.setdefault(a, []).append((-v, b))
        want.setdefault(b, []).append((-v, a))
    want = {a: [b for _, b in sorted(n)[:k]] for a, n in want.items()}
    got = {}
    for r in sorted(ambiguity.completed_neighbours(base(s), s, k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.seq_a, []).append(r.seq_b)
    assert got == want
    got = {}
    for r in sorted(ambiguity.ranked_neighbours(blocks.block_neighbours(s, k, 0.25), k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.seq_a, []).append(r.seq_b)
    assert got == want


def test_traps_of_the_metric(spark):
    one = dict(text="supplier contract plan", local="SupplierPlan", et=["E1"], lob=["L"], tags=["T"], industry=["I"])
    rows = [resource(0, "a", "agent", **one), resource(1, "b", "agent", **one), resource(2, "a", "agent", **one), resource(3, "b", "apiResource", **one), resource(4, "a", "apiResource", **one), resource(5, "c", "agent", "nothing alike", "", [], [], [], [])]
    s = features.scored(spark.createDataFrame(rows, SCHEMA))
    got = table(pairs.dense_pairs(s))
    assert got == oracle(rows)
    assert got[(0, 1)] > got[(0, 2)] > got[(0, 3)] > got[(0, 4)]
    assert got[(0, 5)] == 0.0833 and got[(3, 5)] == 0.0417
    assert (0, 5) not in table(pairs.sparse_pairs(s))


def test_single_and_isolated_resources(spark):
    s = features.scored(spark.createDataFrame([resource(0, text="alone here")], SCHEMA))
    p = pairs.sparse_pairs(s)
    r = ambiguity.resource_ambiguity(ambiguity.completed_neighbours(p, s), ambiguity.counts_above(p), s).collect()[0]
    assert (r.ambiguity_score, r.difficulty_band, r.coverage_gap) == (0.0, "easy", True)


def test_tiers_bands_and_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.0999, 0.1, 0.2499, 0.25, 0.4999, 0.5, 0.75, 1.2, -0.1)], "x double")
    got = df.select(X.tier(F.col("x"), "NONE"), X.difficulty_band(F.col("x"))).collect()
    assert [r[0] for r in got] == ["NONE", "NONE", "low", "low", "medium", "medium", "high", "high", "high", "NONE"]
    assert [r[1] for r in got] == ["easy", "easy", "easy", "medium", "medium", "hard", "hard", "very_hard", "very_hard", "very_hard"]
    ties = spark.createDataFrame([(0.28125,), (0.00015,), (0.49996,), (None,)], "x double")
    assert [r[0] for r in ties.select(python_round(F.col("x"))).collect()] == [0.2812, 0.0001, 0.5, None]
    assert [r[0] for r in ties.select(X.round4(F.col("x"))).collect()] == [0.2813, 0.0002, 0.5, None]


def test_texts_and_ids(spark):
    row = spark.createDataFrame([("The BOM-check of a PLAN, été42 new plan", "BOMCompliance", "ns:kind:HirePlan:v1", "short")], "t string, l string, o string, s string")
    r = row.select(X.tokenize(F.col("t")), X.local_id_tokens(F.col("l"), F.col("o")), X.local_id_tokens(F.lit(""), F.col("o")), X.local_id_tokens(F.lit(None).cast("string"), F.col("s")), X.unicode_words(F.col("t"))).first()
    assert r[0] == ["bom", "check", "plan", "plan"] and r[1] == ["compliance"] and r[2] == ["hire", "plan"] and r[3] == []
    assert "été42" in r[4]
    r = row.select(X.picked_id(F.lit('I pick {"why": 1, "ordId": "a:b:C:v1"} or {"ordId": "x"}')), X.picked_id(F.lit("none")), X.run_ordinal(F.lit("n_a_07")), X.ord_slug(F.lit("a.b:c")), X.case_slug(F.lit("a b/c")), X.distractor_label(F.lit("a"), F.array(F.lit("E")), F.lit("a"), F.array(F.lit("E")))).first()
    assert tuple(r) == ("a:b:C:v1", None, 7, "a-b-c", "a-b-c", "P2")


def test_steps_and_front_matter(spark):
    xml = """<process id="proc_hire_to_retire_v2"><step ordId='a:b:C:v1' id="s1" label="Check / approve" description="the owner's note"/><step id="s2" label="x" description="y" ordId="d"/></process>"""
    md = "---\nname: My skill\ndescription: >\n  two\n  lines\nmetadata:\n  process-type: cmmn\n---\n1. First do <!-- ord_confirmed: a:b:C:v1 -->\n2. Then\n<!-- ord_confirmed: d:e:F:v1, g:h:I:v1 -->\n"
    df = spark.createDataFrame([(xml, md)], "x string, m string")
    r = df.select(X.step_attribute(F.col("x"), "description"), X.step_attribute(F.col("x"), "ordId"), X.process_title(F.col("x")), X.front_matter_value(F.col("m"), "process-type"), X.front_matter_value(F.col("m"), "process-type", nested=False), X.front_matter_value(F.col("m"), "description"), X.skill_steps(F.col("m"))).first()
    assert r[0] == ["the owner's note", "y"] and r[1] == ["a:b:C:v1", "d"] and r[2] == "hire to retire"
    assert (r[3], r[4], r[5]) == ("cmmn", None, "two lines")
    assert [(s.step, s.text, s.ids) for s in r[6]] == [(1, "First do", ["a:b:C:v1"]), (2, "Then", ["d:e:F:v1", "g:h:I:v1"])]


def test_steps_as_xml_has_them(spark):
    texts = [
        """<?xml version="1.0"?><process><!-- <step id="no"/> --><![CDATA[<step id="no"/>]]><phase><step id="a" label="A &amp; B &gt; c &#233;" description=' two '></step></phase><step label="" id='b'/></process>""",
        """<process><step id="a" label="R&D" description="it's" ordId='x "y"'/><step id="b" label="ok"/> broken""",
        "", "no xml", None,
    ]
    got = [r.s and [tuple(x) for x in r.s] for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(X.process_step_tags(F.col("x")).alias("s")).collect()]
    assert got == [[("a", "A & B > c é", " two ", None), ("b", None, None, None)], [("a", "R&D", "it's", 'x "y"'), ("b", "ok", None, None)], [], [], None]


def test_references_by_their_type(spark):
    lists = ['["a", {"ordId": "b"}, "{odd", "{\\"ordId\\": \\"no\\"}", {"x": 1}, {"ordId": null}, null, ""]', "oops", '{"ordId": "a"}', "[]", None]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, j string").orderBy("i")
    got = [tuple(r) for r in df.select(A.mixed_references(F.col("j")), A.only_objects(F.col("j")), A.only_strings(F.col("j"))).collect()]
    text = '{"ordId": "no"}'
    assert got == [(["a", "b", "{odd", text], ["b"], ["a", "{odd", text]), *[([], [], [])] * 4]


def test_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "b"], None, ["b"], [0.0, 0.0], [3.0, 4.0], '["x:y:Z:v1", {"ordId": "u:v:W:v1"}, {"ordId": ""}]')], "a array<string>, n array<string>, b array<string>, z array<double>, v array<double>, j string")
    r = df.select(A.jaccard(F.col("a"), F.col("b")), A.jaccard(F.col("n"), F.col("n")), A.cosine(F.col("z"), F.col("v")), A.cosine(F.col("v"), F.col("v")), A.l2_normalise(F.col("v")), A.mixed_references(F.col("j")), A.only_objects(F.col("j")), A.only_strings(F.col("j")), A.covers(F.col("a"), F.col("b")), A.same_set(F.col("a"), F.array(F.lit("b"), F.lit("a"))), A.is_enriched(F.col("n"), F.col("n"), F.col("b"))).first()
    assert tuple(r) == (0.5, 0.0, 0.0, 1.0, [0.6, 0.8], ["x:y:Z:v1", "u:v:W:v1"], ["u:v:W:v1"], ["x:y:Z:v1"], True, True, True)


def test_cache_keys_escape(spark):
    import hashlib

    got = spark.createDataFrame([("m", "é")], "m string, t string").select(cache_key(F.col("m"), F.col("t"))).first()[0]
    assert got == hashlib.sha256(rb'{"model": "m", "text": "\u00e9"}').hexdigest()


def test_landscape_api(spark, catalogue):
    rows, _ = catalogue
    ls = Landscape(spark.createDataFrame(rows, SCHEMA))
    assert ls.report().count() == ls.scored.count()
    assert ls.neighbours(2).groupBy("seq_a").count().agg(F.max("count")).first()[0] == 2
    assert ls.features().filter("dim = 'text'").count() > 0 and ls.tier_counts().count() == ls.scored.count() and ls.disambiguation().count() == ls.scored.count()
    ls.close()


def test_near_duplicate_reduction(spark, tmp_path):
    one = dict(text="supplier contract plan quality", local="SupplierPlan", et=["E1"], lob=["L"], tags=["T"], industry=["I"])
    rows = [resource(i, "ab"[i % 2], "agent", **one) for i in range(5)] + [resource(9, "c", "agent", "other words entirely", "Unlike", ["E9"], ["M"], [], [])]
    df = spark.createDataFrame(rows, SCHEMA)
    n = [0]

    def cut(x):
        n[0] += 1
        x.write.parquet(f"{tmp_path}/{n[0]}")
        return spark.read.parquet(f"{tmp_path}/{n[0]}")

    left, decisions = reduction.reduce_near_duplicates(df, lambda r: pairs.sparse_pairs(features.scored(r)), cut=cut)
    assert table(pairs.sparse_pairs(features.scored(left)).filter("sim >= 0.75")) == {}
    assert {r.seq for r in left.select("seq").collect()} >= {9} and decisions.count() == 6 - left.count()


def test_profiles_and_clusters(spark):
    df = spark.createDataFrame([resource(0, "sap.sf", "agent", et=["E1", "E2"], lob=["L"], tags=["T"])], SCHEMA).withColumns({"new_type": F.lit("agent"), "new_namespace": F.lit("sap.sf")})
    counts = {t: reduction.candidate_profiles(df, t).count() for t in ("high", "medium", "low")}
    assert counts == {"high": 2, "medium": 3 + 4 + 2 + 2, "low": 2}
    ns = spark.createDataFrame([("sap.sf",), ("sap.s4",), ("workday.hcm",), ("zzz",)], "namespace string")
    assert {r.namespace: r.cluster for r in reduction.cluster_of(ns).collect()} == {"sap.sf": "hr", "sap.s4": "procurement", "workday.hcm": "hr", "zzz": None}
    assert {r.namespace: r.others for r in reduction.related_systems(ns).collect()}["sap.sf"] == ["workday.hcm"]
    assert {r.namespace: r.others for r in reduction.related_systems(ns, inside=False).collect()}["sap.sf"] == ["sap.s4", "zzz"]


def test_convergence(spark, catalogue):
    """Each prefix against the plain sparse metric of that prefix."""
    _, s = catalogue
    staged = s.withColumn("round", (F.col("seq") % 2).cast("int"))
    got = {r["round"]: (r.mean_ambiguity, r.n) for r in reduction.convergence(staged, [0, 1]).collect()}
    for r in (0, 1):
        part = staged.filter(F.col("round") <= r)
        want = ambiguity.mean_top_ambiguity(ambiguity.completed_neighbours(pairs.sparse_pairs(part, use_text=False).persist(), part)).first()
        assert got[r] == (want.mean_ambiguity, want.n)
