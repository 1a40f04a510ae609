"""Readers, writers, streaming and the operators beside the metric."""

import json

from pyspark.sql import functions as F

from catalograph.operators import certification, embedding, enrichment, graph, logs, stats, validate
from catalograph.sources import catalogue, records, sinks
from catalograph.streaming import logs as streaming


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def test_catalogue_with_fallback_and_packages(spark, tmp_path):
    api = {"ordId": "sys.a:apiResource:Orders:v1", "title": "Orders", "partOfPackage": "p1", "lineOfBusiness": [], "exposedEntityTypes": [{"ordId": "sap.odm:entityType:Order:v1"}, "plain"], "industry": ["Retail"]}
    agent = {"ordId": "sys.a:agent:Helper:v1", "title": "Helper", "relatedEntityTypes": ["sap.odm:entityType:Order:v1"], "entityTypeMappings": [{"entityTypeTargets": [{"ordId": "sap.odm:entityType:Item:v1"}]}]}
    dump(tmp_path / "systems/sys.a/ord.json", {"apiResources": [api], "agents": [agent], "packages": [{"ordId": "p1", "title": "Pack", "lineOfBusiness": ["Sales"]}], "integrationDependencies": [{"ordId": "sys.a:integrationDependency:helper-to-x:v1", "aspects": [{"apiResources": [{"ordId": "sys.b:apiResource:X:v1"}]}]}]})
    dump(tmp_path / "systems/sys.b/ord.json", {"dataProducts": [{"ordId": "sys.b:dataProduct:D:v1", "title": "D"}]})
    dump(tmp_path / "systems/sap.odm/ord.json", {"entityTypes": [{"ordId": "sap.odm:entityType:Order:v1", "title": "Order", "relatedEntityTypes": [{"ordId": "sap.odm:entityType:Item:v1"}]}]})
    dump(tmp_path / "systems_enriched/sys.a/ord_enriched.json", {"apiResources": [{**api, "capabilities": ["c"]}], "agents": [agent], "packages": [{"ordId": "p1", "title": "Pack", "lineOfBusiness": ["Sales"]}]})
    clean = catalogue.documents(spark, str(tmp_path / "systems"))
    docs = catalogue.with_fallback(catalogue.documents(spark, str(tmp_path / "systems_enriched")), clean)
    rows = {r.id: r for r in catalogue.number(catalogue.resources(docs)).collect()}
    assert sorted(r.seq for r in rows.values()) == [0, 1, 2] and rows["sys.b:dataProduct:D:v1"].seq == 2
    orders = rows["sys.a:apiResource:Orders:v1"]
    assert (orders.line_of_business, orders.package_title, orders.capabilities, orders.industry) == (["Sales"], "Pack", ["c"], [])
    assert orders.entity_types == ["sap.odm:entityType:Order:v1"]
    assert rows["sys.a:agent:Helper:v1"].entity_types == ["sap.odm:entityType:Item:v1", "sap.odm:entityType:Order:v1"]
    raw = {r.id: r for r in catalogue.resources(clean, raw=True).collect()}
    assert (raw[orders.id].line_of_business, raw[orders.id].industry, raw[orders.id].entity_types) == ([], ["Retail"], ["sap.odm:entityType:Order:v1", "plain"])
    assert [r.id for r in catalogue.entity_ids(clean).collect()] == ["sap.odm:entityType:Order:v1"]
    calls = graph.agent_calls(catalogue.dependencies(clean), catalogue.resources(clean).filter("type = 'agent'"))
    assert [tuple(r) for r in calls.collect()] == [("sys.a:agent:Helper:v1", "sys.b:apiResource:X:v1")]
    nodes, edges = graph.landscape_graph(catalogue.resources(docs))
    assert {r.kind: r.n for r in graph.kind_totals(nodes, edges).filter("what = 'node'").collect()} == {"system": 2, "apiResource": 1, "agent": 1, "dataProduct": 1, "entityType": 2}


def test_records(spark, tmp_path):
    dump(tmp_path / "runs/dy-01/run_01.json", {"nonce": "dy-01_1", "output": {"picked_ordId": "x"}, "expected_ordIds": ["x"], "solved": True, "cached": False, "latency_s": 2.0, "tokens": 10})
    (tmp_path / "runs/dy-01/run_02.json").write_text("{broken")
    got = records.certification_runs(spark, str(tmp_path / "runs")).collect()
    assert [(r.case_id, r.run, r.solved, r.picked) for r in got] == [("dy-01", 1, True, "x")]
    dump(tmp_path / "prov/a.json", [{"case_id": "sg-1", "mode": "SG", "gap_resources": [{"ordId": "p"}, {"ordId": "q"}]}, {"case_id": "sa-1", "mode": "SA", "gap_resources": [{"ordId": "p"}, {"ordId": "q"}]}, {"case_id": "oos-1", "mode": "OOS"}])
    assert {r.case_id: r.expected for r in records.provenance(spark, str(tmp_path / "prov")).collect()} == {"sg-1": ["p"], "sa-1": ["p", "q"]}
    (tmp_path / "skills").mkdir()
    (tmp_path / "skills/proc_1.md").write_text("---\nname: n\nmetadata:\n  process-type: cmmn\n---\n1. Do <!-- ord_confirmed: a:b:C:v1 -->\n")
    s = records.skills(spark, str(tmp_path / "skills"))
    assert (s.first().process_type, s.first().confirmed) == ("cmmn", ["a:b:C:v1"])
    assert records.skills(spark, str(tmp_path / "skills"), compat=True).first().process_type == "bpmn"
    (tmp_path / "proc").mkdir()
    (tmp_path / "proc/proc_1.xml").write_text('<process id="proc_hire_v1"><step id="s" label="L" description="D" ordId="a:b:C:v1"/></process>')
    steps = records.process_steps(records.processes(spark, str(tmp_path / "proc")))
    case = records.design_cases(steps, spark.createDataFrame([("proc_1", ["a:b:C:v1"])], "process_id string, gt_ids array<string>")).first()
    assert (case.case_id, case.input, case.is_gt) == ("proc_1_s01", "L — D", True)
    empty = records.or_empty(spark, lambda: records.json_lines(spark, str(tmp_path / "absent"), "a int"), "a int")
    assert empty.count() == 0


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    rows = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(sinks.upsert(t, rows)) == [("a", 1), ("b", 3), ("c", 4)]
    assert got(sinks.update(t, rows)) == [("a", 1), ("b", 3)]
    assert got(sinks.delete(t, rows)) == [("a", 1)]
    assert got(sinks.ensure(t, rows, "id")) == [("a", 1), ("b", 2), ("c", 4)]
    pair = spark.createDataFrame([("a", "b", 0.28125, 0.5)], "ordId_A string, ordId_B string, structural_sim double, embedding_cos double")
    sinks.write_pairs_csv(pair, str(tmp_path / "csv"))
    assert records.frozen_pairs(spark, str(tmp_path / "csv")).first().embedding_cos == 0.5
    assert sinks.certification_markdown(t.orderBy("id")).splitlines()[2] == "| a | 1 |"


def test_certification_classes(spark):
    rows = [(f"{n}-{k}", i < k) for n in (1, 4, 5, 10) for k in (0, 1, 2) if k <= n for i in range(n)]
    got = {r.case_id: r.verdict for r in certification.certify(spark.createDataFrame(rows, "case_id string, solved boolean")).collect()}
    assert got == {"1-0": "robust", "1-1": "too_easy", "4-0": "robust", "4-1": "too_easy", "4-2": "too_easy", "5-0": "robust", "5-1": "borderline", "5-2": "too_easy", "10-0": "robust", "10-1": "borderline", "10-2": "borderline"}


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (4.0, 9.0)], "x double, y double")
    assert stats.spearman(df, "x", "y").first().rho == 0.8333
    flat = df.withColumn("x", F.lit(1.0))
    assert stats.pearson(flat, "x", "y").first().r == 0.0
    assert {r.x: r["median"] for r in stats.medians(df, "x", "y").collect()} == {1.0: 2.5, 2.0: 3.0, 4.0: 9.0}


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "p"), (1, [2.0, 0.0], "p"), (2, [0.0, 1.0], "q"), (3, [0.0, 0.0], "q"), (4, [-1.0, 0.0], "q")], "id long, vector array<double>, label string")
    a = {(r.id_a, r.id_b): round(r.cos, 9) for r in embedding.cosine_pairs(df).collect()}
    b = {(r.id_a, r.id_b): round(r.cos, 9) for r in embedding.block_cosine(df).collect()}
    assert a == b and a[(0, 1)] == 1 and a[(0, 4)] == -1 and a[(0, 3)] == 0
    cases = spark.createDataFrame([(7, [1.0, 0.0], 3), (8, [1.0, 0.0], 0)], "case_id long, prompt array<double>, correct_id long")
    s = embedding.ambiguity_scores(cases, df)
    best = {r.case_id: r.id for r in embedding.best_distractor(s).collect()}
    assert best == {7: None, 8: 1}
    c = {r.id: r.cluster for r in embedding.cosine_kmeans(df.filter("id <> 3"), 2).collect()}
    assert c[0] == c[1] != c[4]


def test_logs_and_enrichment(spark):
    log = spark.createDataFrame([("iterative", "create", "accepted", 1, {"c2_coherent": True}), ("iterative", "create", "rejected_judge", 1, {"c2_coherent": False}), ("iterative", "create", "rejected_judge", 2, {"c2_coherent": None}), ("iterative", "create", "rejected_judge", 2, None), ("seed", "create", "accepted", 0, None)], "phase string, action string, outcome string, round int, judge_verdict map<string,boolean>")
    g = logs.gate_stats(log).first()
    assert (g.created, g.reached_judge, g.accepted, g.incoherent, g.acceptance_rate) == (4, 4, 1, 1, 25.0)
    prov = spark.createDataFrame([("dy-1", "DY", [("ok",), ("no",)]), ("dy-2", "DY", None)], "case_id string, mode string, evolution_log array<struct<outcome:string>>")
    assert sorted(tuple(r) for r in logs.evolution_outcomes(prov).collect()) == [("dy", "no", 1), ("dy", "ok", 1)]
    assert tuple(logs.iteration_stats(prov).first()) == ("DY", 2, 3, 50.0)
    rows = spark.createDataFrame([("r", "p2", ["b"], ["u"], ["g"], ["n2"]), ("r", "p1", ["a", "b"], None, ["g"], [])], "id string, process_id string, capabilities array<string>, use_cases array<string>, groups array<string>, process_next array<string>")
    m = enrichment.merge_enrichment(rows).first()
    assert (m.capabilities, m.use_cases, m.groups, m.process_next) == (["a", "b"], ["u"], ["g", "g"], ["n2"])


def test_validators(spark):
    s = spark.createDataFrame([("ok", "1. Do <!-- ord_confirmed: a:b:C:v1 -->", ["a:b:C:v1"]), ("none", "1. Do", ["a"]), ("leak", "1. a:b:C:v1 <!-- ord_confirmed: a:b:C:v1 -->", ["a:b:C:v1"]), ("twice", "<!-- ord_confirmed: a\n--><!-- ord_confirmed: a\n-->", ["a"])], "process_id string, text string, gt array<string>")
    assert {r.process_id: r.first_failed for r in validate.validate_skill(s).collect()} == {"ok": None, "none": "S1", "leak": "S4", "twice": "S3"}
    p = spark.createDataFrame([("a", "please find me the orders", ["x:y:Orders:v1"], []), ("b", "short", ["q:r:Zed:v1"], []), ("c", "please find me the invoices", ["x:y:Orders:v1"], ["x:y:Orders:v1"]), ("d", "please find me something else", ["un:k:Nown:v1"], None)], "case_id string, prompt string, expected array<string>, skill array<string>")
    res = spark.createDataFrame([("x:y:Orders:v1",), ("q:r:Zed:v1",)], "id string")
    assert {r.case_id: r.first_failed for r in validate.validate_prompts(p, res).collect()} == {"a": "no_leak", "b": "length", "c": "not_in_skill", "d": "known_ids"}
    d = spark.createDataFrame([("i", "integrationDependency", [], None), ("r", "apiResource", None, [{"type": "x"}, {"type": "y", "url": "z"}])], "id string, type string, aspects array<struct<apiResources:array<string>,eventResources:array<string>,dataProducts:array<string>>>, resource_definitions array<map<string,string>>")
    out = {r.id: r.errors for r in validate.validate_resources(d, {"apiResource": {"resourceDefinitions_item_required": ["url"]}}).collect()}
    assert out == {"i": ["MISSING aspects (at least one required)"], "r": ["resourceDefinitions[0] MISSING required field 'url'"]}


def test_log_stream(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    for i, o in enumerate(["accepted", "wrong_tier", "accepted"]):
        (src / f"{i}.json").write_text(json.dumps({"phase": "iterative", "action": "create", "outcome": o, "round": 1, "timestamp": f"2024-01-01T00:0{i}:00Z"}) + "\n")
    events = streaming.log_stream(spark, str(src), 1)
    q = streaming.round_counts(events).writeStream.outputMode("complete").format("memory").queryName("rounds").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("rounds").collect()] == [(1, 3, 2, 0)]
    seen = []
    q = streaming.maintain(events, lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 3
