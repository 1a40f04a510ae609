"""Registered queries of readers and writers: files made from the test tables, read back through the loaders, each with its SQL over those tables.

A system is a nation; its APIs are its suppliers, its agents its customers. Every second system has an enriched document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import group_ids, short_entity_types
from ..operators import certification as C
from ..operators import graph as G
from ..operators import logs as L
from ..operators import validate as Q
from ..schema import LOG_EVENT, TAXONOMY_NAMESPACE
from ..session import shared_folder
from ..sources import catalogue, records, sinks, snapshots
from ..sources.fixtures import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _filled(spark: SparkSession, tag: str, write: Callable[[str], None]) -> str:
    """A new folder that write() filled for this use, so that a reader sees the tables as they are."""
    path = shared_folder(spark, tag)
    write(path)
    return path


# JSON text by expressions: values are texts without quotes.


def _q(*parts) -> Column:
    """A JSON string of the parts put together."""
    return F.concat(F.lit('"'), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts], F.lit('"'))


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _object(**fields: Column) -> Column:
    """A JSON object; null fields are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))


#: Keys a document or a file covers: each key is there once, so no file has more items, whatever the size of a table.
PIECE = 1_000


def _gathered(rows: DataFrame, keys: list[str], order: str, item: Column, into: str) -> DataFrame:
    """One JSON list, in order, for each value of the keys and each piece of PIECE values of `order`."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))), lambda e: e["x"])
    piece = F.floor(F.col(order) / PIECE).cast("long").alias("piece")
    return rows.groupBy(*keys, piece).agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias(into))


def _document_rows(spark: SparkSession, sf_dir: str, enriched: bool) -> DataFrame:
    """(namespace, piece, value): the documents of every system as JSON text; a system has one for each piece of its suppliers and customers, the first with its packages."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    nation = nation.filter("k % 2 = 0") if enriched else nation
    ns = F.concat(F.lit("ns"), (F.col("k") + 10).cast("string"))
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    kind = lambda *x: _q(f"{TAXONOMY_NAMESPACE}:entityType:", *x, ":v1")
    more = {"capabilities": _list(_q("C", s % 9))} if enriched else {}
    api = _object(
        ordId=_q(ns, ":apiResource:Api", s, ":v1"), title=_q(F.col("s_name")), shortDescription=_q("acct ", s % 7), description=F.when(s % 2 == 0, _q("about ", s)),
        partOfPackage=_q(ns, ":package:P", s % 3, ":v1"), lineOfBusiness=F.when(s % 2 == 0, F.lit("[]")).otherwise(_list(_q("Own", s % 4))), tags=_list(_q("t", s % 5)), industry=_list(_q("I", s % 3)),
        exposedEntityTypes=_list(_object(ordId=kind("E", s % 6)), _q("{plain", s % 4)), partOfGroups=_list(_object(groupId=_q("G", s % 4), groupTypeId=_q("x"))), **more,
    )
    agent = _object(ordId=_q(ns, ":agent:Agent", c, ":v1"), localId=_q("Agent", c), title=_q(F.col("c_name")), relatedEntityTypes=_list(kind("E", c % 6), kind("E", (c + 1) % 6)), entityTypeMappings=_list(_object(entityTypeTargets=_list(_object(ordId=kind("M", c % 3))))))
    pack = lambda i, **f: _object(ordId=_q(ns, f":package:P{i}:v1"), title=_q("Pack ", F.col("k"), f"-{i}"), **f)
    need = _object(ordId=_q(ns, ":integrationDependency:agent", c, "-to-other:v1"), title=_q("calls of ", c), aspects=_list(_object(title=_q("a"), apiResources=_list(_object(ordId=_q(ns, ":apiResource:Api", c, ":v1"))), dataProducts=_list(_object(ordId=_q("x:dataProduct:D", c % 3, ":v1"))))))
    suppliers = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_nationkey").cast("long"))
    customers = table(spark, sf_dir, "customer").withColumn("k", F.col("c_nationkey").cast("long"))
    apis, agents, calls = _gathered(suppliers, ["k"], "s_suppkey", api, "apis"), _gathered(customers, ["k"], "c_custkey", agent, "agents"), _gathered(customers, ["k"], "c_custkey", need, "calls")
    first = nation.select("k", F.lit(0).cast("long").alias("piece"))
    pieces = first.unionByName(apis.select("k", "piece")).unionByName(agents.select("k", "piece")).distinct()
    rows = nation.join(pieces, "k").join(apis, ["k", "piece"], "left").join(agents, ["k", "piece"], "left").join(calls, ["k", "piece"], "left")
    packages = F.when(F.col("piece") == 0, _list(pack(0, lineOfBusiness=_list(_q("Pk", F.col("k") % 3))), pack(1)))
    document = _object(apiResources=F.col("apis"), agents=F.col("agents"), packages=packages, integrationDependencies=F.col("calls"))
    out = rows.select(ns.alias("namespace"), "piece", document.alias("value"))
    if enriched:
        return out
    i = F.col("id")
    entry = _object(ordId=kind("E", i), title=_q("Entity ", i), partOfPackage=_q(f"{TAXONOMY_NAMESPACE}:package:P0:v1"), relatedEntityTypes=_list(_object(ordId=kind("E", (i + 1) % 6)), kind("X", i)))
    taxonomy = _gathered(table(spark, sf_dir, "part").select((F.col("p_partkey") % 6).alias("id")).distinct(), [], "id", entry, "types")
    return out.unionByName(taxonomy.select(F.lit(TAXONOMY_NAMESPACE).alias("namespace"), "piece", _object(entityTypes=F.col("types"), packages=_list(_object(ordId=_q(f"{TAXONOMY_NAMESPACE}:package:P0:v1"), title=_q("Taxonomy")))).alias("value")))


def _clean(spark: SparkSession, sf_dir: str, enriched: bool = False) -> DataFrame:
    rows = lambda path: _document_rows(spark, sf_dir, enriched).write.partitionBy("namespace", "piece").text(path)
    path = _filled(spark, "documents-enriched" if enriched else "documents", rows)
    part = lambda name: F.regexp_extract("_metadata.file_path", f"{name}=([^/]+)", 1)
    return catalogue.documents(spark, path, part("namespace"), part("piece").cast("long"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.with_fallback(_clean(spark, sf_dir, True), _clean(spark, sf_dir))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.resources(_documents(spark, sf_dir))


CATALOGUE = f"""WITH e AS (SELECT '{TAXONOMY_NAMESPACE}:entityType:' AS p),
api AS (SELECT 'ns' || (10 + s_nationkey) AS namespace, 0 AS a, s_suppkey AS pos, 'ns' || (10 + s_nationkey) || ':apiResource:Api' || s_suppkey || ':v1' AS id, 'apiResource' AS type, s_name AS title, 'acct ' || (s_suppkey % 7) AS short_description,
  CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || s_suppkey ELSE '' END AS description, CASE WHEN s_suppkey % 3 < 2 THEN 'Pack ' || s_nationkey || '-' || (s_suppkey % 3) ELSE '' END AS package_title,
  CASE WHEN s_suppkey % 2 = 1 THEN ['Own' || (s_suppkey % 4)] WHEN s_suppkey % 3 = 0 THEN ['Pk' || (s_nationkey % 3)] ELSE CAST([] AS VARCHAR[]) END AS line_of_business,
  CASE WHEN s_suppkey % 2 = 1 THEN ['Own' || (s_suppkey % 4)] ELSE CAST([] AS VARCHAR[]) END AS own_lob, ['t' || (s_suppkey % 5)] AS tags, ['I' || (s_suppkey % 3)] AS industry, ['G' || (s_suppkey % 4)] AS groups,
  [p || 'E' || (s_suppkey % 6) || ':v1'] AS entity_types, [p || 'E' || (s_suppkey % 6) || ':v1', '{{plain' || (s_suppkey % 4)] AS raw_types, CASE WHEN s_nationkey % 2 = 0 THEN ['C' || (s_suppkey % 9)] ELSE CAST([] AS VARCHAR[]) END AS capabilities FROM supplier, e),
agent AS (SELECT 'ns' || (10 + c_nationkey) AS namespace, 1 AS a, c_custkey AS pos, 'ns' || (10 + c_nationkey) || ':agent:Agent' || c_custkey || ':v1' AS id, 'agent' AS type, c_name AS title, '' AS short_description, '' AS description, '' AS package_title,
  CAST([] AS VARCHAR[]) AS line_of_business, CAST([] AS VARCHAR[]) AS own_lob, CAST([] AS VARCHAR[]) AS tags, CAST([] AS VARCHAR[]) AS industry, CAST([] AS VARCHAR[]) AS groups,
  [p || 'M' || (c_custkey % 3) || ':v1', p || 'E' || (c_custkey % 6) || ':v1', p || 'E' || ((c_custkey + 1) % 6) || ':v1'] AS entity_types, [p || 'E' || (c_custkey % 6) || ':v1', p || 'E' || ((c_custkey + 1) % 6) || ':v1'] AS raw_types, CAST([] AS VARCHAR[]) AS capabilities FROM customer, e),
r AS (SELECT * FROM api UNION ALL SELECT * FROM agent)
"""


@query(CATALOGUE + "SELECT (row_number() OVER (ORDER BY namespace, a, pos) - 1) AS seq, id, namespace, type, title, short_description, description, package_title, line_of_business, entity_types, capabilities, tags, groups FROM r")
def catalogue_resources(spark, sf_dir):
    r = catalogue.number(_resources(spark, sf_dir))
    return r.select("seq", "id", "namespace", "type", "title", "short_description", "description", "package_title", "line_of_business", "entity_types", "capabilities", "tags", "groups")


@query(CATALOGUE + "SELECT id, raw_types AS entity_types, own_lob AS line_of_business, industry FROM r")
def catalogue_raw(spark, sf_dir):
    return catalogue.resources(_clean(spark, sf_dir), raw=True).select("id", "entity_types", "line_of_business", "industry")


@query(CATALOGUE + "SELECT id, list_transform(entity_types, lambda x: split_part(x, ':', 3)) AS names, groups FROM r")
def entity_names(spark, sf_dir):
    r = _resources(spark, sf_dir)
    wrapped = F.transform("groups", lambda g: F.struct(g.alias("groupId"), F.lit("x").alias("groupTypeId")))
    return r.select("id", short_entity_types(F.col("entity_types")).alias("names"), group_ids(wrapped).alias("groups"))


@query(f"SELECT 'ns' || (10 + n_nationkey) AS namespace, 'ns' || (10 + n_nationkey) || ':package:P' || i || ':v1' AS package_id, 'Pack ' || n_nationkey || '-' || i AS package_title, CASE WHEN i = 0 THEN ['Pk' || (n_nationkey % 3)] END AS package_lob FROM nation, range(2) t(i) UNION ALL SELECT '{TAXONOMY_NAMESPACE}', '{TAXONOMY_NAMESPACE}:package:P0:v1', 'Taxonomy', NULL")
def catalogue_packages(spark, sf_dir):
    return catalogue.packages(_documents(spark, sf_dir)).select("namespace", "package_id", "package_title", "package_lob")


@query(f"SELECT 'ns' || (10 + n_nationkey) AS namespace, 'ns' || (10 + n_nationkey) || ':package:P' || i || ':v1' AS package_id, CASE WHEN n_nationkey = 3 THEN 'Third system' ELSE 'Pack ' || n_nationkey || '-' || i END AS title FROM nation, range(2) t(i) UNION ALL SELECT '{TAXONOMY_NAMESPACE}', '{TAXONOMY_NAMESPACE}:package:P0:v1', 'Taxonomy'")
def system_titles(spark, sf_dir):
    return catalogue.package_titles(_clean(spark, sf_dir), {"ns13": "Third system"})


@query(CATALOGUE + ", n AS (SELECT *, row_number() OVER (ORDER BY namespace, a, pos) - 1 AS seq FROM r) SELECT id, CASE WHEN seq % 3 = 0 THEN 'gt' ELSE 'other' END AS pool FROM n")
def ground_truth_pools(spark, sf_dir):
    """Every third resource is eligible."""
    r = catalogue.number(_resources(spark, sf_dir))
    eligible = r.filter("seq % 3 = 0").select("seq")
    return catalogue.ground_truth(r, eligible).select("id", F.lit("gt").alias("pool")).unionByName(r.join(eligible, "seq", "left_anti").select("id", F.lit("other").alias("pool")))


@query("SELECT 'ns' || (10 + c_nationkey) AS namespace, 'ns' || (10 + c_nationkey) || ':integrationDependency:agent' || c_custkey || '-to-other:v1' AS id, 'calls of ' || c_custkey AS title, 1 AS n_aspects FROM customer")
def catalogue_dependencies(spark, sf_dir):
    return catalogue.dependencies(_clean(spark, sf_dir)).select("namespace", "id", "title", F.size("aspects").alias("n_aspects"))


@query("SELECT 'ns' || (10 + c_nationkey) || ':agent:Agent' || c_custkey || ':v1' AS agent_id, unnest(['ns' || (10 + c_nationkey) || ':apiResource:Api' || c_custkey || ':v1', 'x:dataProduct:D' || (c_custkey % 3) || ':v1']) AS target_id FROM customer")
def agent_calls(spark, sf_dir):
    docs = _clean(spark, sf_dir)
    return G.agent_calls(catalogue.dependencies(docs), catalogue.resources(docs).filter("type = 'agent'"))


@query(f"SELECT '{TAXONOMY_NAMESPACE}:entityType:E' || i || ':v1' AS id, 'Entity ' || i AS title, 'Taxonomy' AS package_title, ['{TAXONOMY_NAMESPACE}:entityType:E' || ((i + 1) % 6) || ':v1', '{TAXONOMY_NAMESPACE}:entityType:X' || i || ':v1'] AS related FROM (SELECT DISTINCT p_partkey % 6 AS i FROM part)")
def catalogue_entity_types(spark, sf_dir):
    return catalogue.entity_types(_documents(spark, sf_dir)).select("id", "title", "package_title", "related")


@query(f"SELECT '{TAXONOMY_NAMESPACE}:entityType:E' || i || ':v1' AS id FROM (SELECT DISTINCT p_partkey % 6 AS i FROM part)")
def catalogue_entity_ids(spark, sf_dir):
    return catalogue.entity_ids(_documents(spark, sf_dir))


@query(CATALOGUE + "SELECT id FROM r WHERE namespace = 'ns11' AND type = 'agent'")
def saved_ids(spark, sf_dir):
    return catalogue.of_type(_resources(spark, sf_dir), "ns11", "agent")


@query(CATALOGUE + "SELECT id, title FROM r WHERE type = 'apiResource' AND pos = 7")
def resource_by_id(spark, sf_dir):
    r = catalogue.number(_resources(spark, sf_dir))
    home = table(spark, sf_dir, "supplier").filter("s_suppkey = 7").first()["s_nationkey"]
    return catalogue.by_id(r, f"ns{10 + home}:apiResource:Api7:v1").select("id", "title")


@query(CATALOGUE + "SELECT s_suppkey AS request, (i - 1)::INT AS position, r.id, r.title FROM supplier, range(1, 4) t(i) JOIN r ON r.id = CASE i WHEN 1 THEN 'ns' || (10 + s_nationkey) || ':apiResource:Api' || s_suppkey || ':v1' WHEN 2 THEN 'unknown' ELSE 'ns' || (10 + s_nationkey) || ':agent:Agent' || s_suppkey || ':v1' END")
def resources_of_ids(spark, sf_dir):
    """A list of three ids for each supplier: its API, an unknown one, an agent that may exist."""
    ns = F.concat(F.lit("ns"), F.col("s_nationkey") + 10)
    ids = F.array(F.concat(ns, F.lit(":apiResource:Api"), "s_suppkey", F.lit(":v1")), F.lit("unknown"), F.concat(ns, F.lit(":agent:Agent"), "s_suppkey", F.lit(":v1")))
    lists = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request"), ids.alias("ids"))
    return catalogue.of_ids(lists, _resources(spark, sf_dir)).select("request", "position", "id", "title")


@query(CATALOGUE + "SELECT namespace, type, list(id ORDER BY id) AS ids, count(*) AS n FROM r GROUP BY 1, 2")
def resources_by_type(spark, sf_dir):
    return catalogue.grouped(_resources(spark, sf_dir), "namespace", "type")


@query(CATALOGUE + "SELECT id, namespace, row_number() OVER (PARTITION BY namespace ORDER BY title, id) AS position FROM r WHERE type = 'agent'")
def titles_in_order(spark, sf_dir):
    return catalogue.titled_order(_resources(spark, sf_dir).filter("type = 'agent'"), "title", "namespace").select("id", "namespace", F.col("position").cast("long").alias("position"))


# Reports, logs, cases, runs.


def _arrays(rows: DataFrame, order: str, item: Column) -> Callable[[str], None]:
    """A writer of JSON arrays, one file for each piece."""
    return lambda path: _gathered(rows, [], order, item, "value").write.partitionBy("piece").text(path)


@query("SELECT 'p' || p_partkey AS \"ordId\", round(p_size / 50.0, 4) AS ambiguity_score, p_size % 2 = 0 AS coverage_gap, 'p' || (p_partkey + 1) AS nearest FROM part")
def ambiguity_report_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    near = _list(_object(ordId=_q("p", F.col("p_partkey") + 1), sim=F.lit("0.5")))
    item = _object(ordId=_q("p", F.col("p_partkey")), title=_q(F.col("p_name")), ambiguity_score=F.round(F.col("p_size") / 50.0, 4).cast("string"), coverage_gap=(F.col("p_size") % 2 == 0).cast("string"), top_neighbors=near)
    whole = _gathered(p, [], "p_partkey", item, "list").select("piece", _object(resources=F.col("list")).alias("value"))
    path = _filled(spark, "report", lambda at: whole.write.partitionBy("piece").text(at))
    return records.ambiguity_report(spark, path).select("ordId", "ambiguity_score", "coverage_gap", F.col("top_neighbors")[0]["ordId"].alias("nearest"))


_OUTCOMES = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected_judge' ELSE 'wrong_tier' END"


def _log_item() -> Column:
    outcome = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected_judge").otherwise("wrong_tier")
    return _object(timestamp=_q(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), phase=_q("iterative"), action=_q("create"), outcome=_q(outcome), ordId=_q("e", F.col("event_id")), round=(1 + F.col("user_id") % 5).cast("string"), judge_verdict=_object(c2_coherent=(F.col("event_id") % 2 == 0).cast("string")))


@query(f"SELECT 'e' || event_id AS \"ordId\", {_OUTCOMES} AS outcome, (1 + user_id % 5)::INT AS round, date_trunc('second', ts)::TIMESTAMP AS ts, event_id % 2 = 0 AS coherent FROM events")
def generation_log_rows(spark, sf_dir):
    path = _filled(spark, "log", _arrays(table(spark, sf_dir, "events"), "event_id", _log_item()))
    return records.generation_log(spark, path).select("ordId", "outcome", "round", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("judge_verdict")["c2_coherent"].alias("coherent"))


@query(f"SELECT {_OUTCOMES} AS outcome, count(*) AS n FROM events WHERE event_id % 50 <> 3 GROUP BY 1")
def json_lines_rows(spark, sf_dir):
    """Every fiftieth line is blank."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 == 3, F.lit("")).otherwise(_log_item()).alias("value"))
    path = _filled(spark, "lines", lambda at: e.write.text(at))
    return L.outcome_counts(records.json_lines(spark, path, LOG_EVENT)).select("outcome", "n")


@query("SELECT 'p' || p_partkey AS \"ordId_A\", 'q' || p_partkey AS \"ordId_B\", CAST(printf('%.4f', p_size / 51.0) AS DOUBLE) AS structural_sim, CAST(printf('%.4f', p_size / 70.0) AS DOUBLE) AS embedding_cos FROM part")
def frozen_pair_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pairs = p.select(F.concat(F.lit("p"), "p_partkey").alias("ordId_A"), F.concat(F.lit("q"), "p_partkey").alias("ordId_B"), (F.col("p_size") / 51.0).alias("structural_sim"), (F.col("p_size") / 70.0).alias("embedding_cos"))
    return records.frozen_pairs(spark, _filled(spark, "pairs", lambda at: sinks.write_pairs_csv(pairs, at)))


_MODES = {"1-URGENT": "SG", "2-HIGH": "SA", "3-MEDIUM": "DY", "4-NOT SPECIFIED": "OOS", "5-LOW": "XX"}
_MODE_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MODES.items()) + " END"


def _mode() -> Column:
    return F.create_map(*[F.lit(x) for kv in _MODES.items() for x in kv])[F.col("o_orderpriority")]


def _runtime_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases of five modes; an order has a log of o_orderkey mod 4 steps."""
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    steps = F.array_join(F.slice(F.array(*[_object(outcome=_q(x), note=_q("n")) for x in ("too_easy", "judge_fail", "accepted")]), F.lit(1), (i % 4).cast("int")), ",")
    item = _object(case_id=_q(F.lower(_mode()), "-", i), query_class=_q("c", i % 3), prompt=_q("prompt ", i), expected_ordIds=_list(_q("x", i % 7)), evolution_log=F.concat(F.lit("["), steps, F.lit("]")))
    paths = {v: _filled(spark, f"cases-{v}", _arrays(o.filter(F.col("o_orderpriority") == k), "o_orderkey", item)) for k, v in _MODES.items()}
    return records.runtime_cases(spark, paths)


@query(f"SELECT lower({_MODE_SQL}) || '-' || o_orderkey AS case_id, {_MODE_SQL} AS mode, 'prompt ' || o_orderkey AS prompt, ['x' || (o_orderkey % 7)] AS expected FROM orders")
def runtime_case_rows(spark, sf_dir):
    return _runtime_cases(spark, sf_dir).select("case_id", "mode", "prompt", F.col("expected_ordIds").alias("expected"))


@query(f"SELECT {_MODE_SQL} AS mode, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def known_modes(spark, sf_dir):
    return records.of_known_modes(_runtime_cases(spark, sf_dir)).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT lower({_MODE_SQL}) AS prefix, unnest(['too_easy', 'judge_fail', 'accepted'][1:o_orderkey % 4]) AS outcome, count(*) AS n FROM orders GROUP BY 1, 2")
def evolution_outcomes(spark, sf_dir):
    return L.evolution_outcomes(_runtime_cases(spark, sf_dir))


@query(f"SELECT {_MODE_SQL} AS mode, count(*) AS cases, sum(greatest(1, o_orderkey % 4))::BIGINT AS iterations, round(100.0 * count(*) FILTER (o_orderkey % 4 <= 1) / count(*), 1) AS one_shot_pct FROM orders GROUP BY 1")
def iteration_stats(spark, sf_dir):
    return L.iteration_stats(_runtime_cases(spark, sf_dir))


@query(f"SELECT 'c' || o_orderkey AS case_id, CASE {_MODE_SQL} WHEN 'SA' THEN ['g' || (o_orderkey % 5), 'h' || (o_orderkey % 3)] WHEN 'XX' THEN ['a' || (o_orderkey % 2)] ELSE ['g' || (o_orderkey % 5)] END AS expected FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def provenance_expected(spark, sf_dir):
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    gaps = _list(_object(ordId=_q("g", i % 5)), _object(ordId=_q("h", i % 3)))
    item = _object(case_id=_q("c", i), mode=_q(_mode()), gap_resources=F.when(i % 2 == 0, gaps), selected_resources=F.when(i % 2 == 1, gaps), accepted_case=_object(expected_ordIds=_list(_q("a", i % 2)), prompt=_q("p")))
    path = _filled(spark, "provenance", _arrays(o, "o_orderkey", item))
    return records.provenance(spark, path).select("case_id", "expected")


@query("SELECT 'case' || s_suppkey AS case_id, i::INT AS run, (s_suppkey + i) % 3 = 0 AS solved, 'r' || i AS picked FROM supplier, range(1, 4) t(i) WHERE NOT (s_suppkey % 5 = 0 AND i = 2)")
def certification_run_files(spark, sf_dir):
    """Three run files for each supplier; the second of every fifth is broken."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    k, i = F.col("k"), F.col("i")
    run = _object(nonce=_q("case", k, "_", i), output=_object(picked_ordId=_q("r", i)), expected_ordIds=_list(_q("r1")), solved=((k + i) % 3 == 0).cast("string"), cached=F.lit("false"), latency_s=F.lit("1.5"), tokens=F.lit("10"))
    text = F.when((k % 5 == 0) & (i == 2), "{broken").otherwise(run)
    path = _filled(spark, "runs", lambda at: rows.select(F.concat(F.lit("case"), k).alias("case"), i.alias("run"), text.alias("value")).write.partitionBy("case", "run").text(at))
    return records.certification_runs(spark, path, F.regexp_extract("_path", "case=([^/]+)", 1)).select("case_id", "run", "solved", "picked")


@query(f"SELECT 'c' || o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN 'old' WHEN k.n IS NOT NULL THEN '{{\"n_runs\":' || k.n || ',\"n_solved\":' || k.s || ',\"verdict\":\"' || CASE WHEN k.s = 0 THEN 'robust' WHEN k.s <= k.n // 5 THEN 'borderline' ELSE 'too_easy' END || '\"}}' END AS block FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS s FROM lineitem GROUP BY 1) k ON l_orderkey = o_orderkey")
def annotated_cases(spark, sf_dir):
    """Orders as cases; the block of every third one stays, the others take theirs from new runs."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_orderkey").alias("case_id"), F.col("o_orderkey").alias("k"))
    runs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), "l_orderkey").alias("case_id"), (F.col("l_returnflag") == "A").alias("solved"))
    provenance = o.filter("k % 3 = 0").select("case_id", F.lit("old").alias("block"))
    return C.annotate(o.select("case_id"), provenance, C.certify(runs)).select("case_id", "block")


@query("SELECT conv_id || '_' || turn AS case_id, CASE WHEN conv_id % 2 = 0 THEN 'Conversation ' || conv_id || ' / ' || role ELSE role END AS label, [role] AS expected FROM conversations WHERE turn % 2 = 0")
def loaded_cases(spark, sf_dir):
    """Even turns are ground truth; every second process has a title."""
    c = table(spark, sf_dir, "conversations")
    cases = c.select(F.concat_ws("_", "conv_id", "turn").alias("case_id"), F.col("conv_id").alias("process_id"), F.col("role").alias("input"), F.col("role").alias("expected_ordId"), (F.col("turn") % 2 == 0).alias("is_gt"))
    titles = c.filter("conv_id % 2 = 0").select(F.col("conv_id").alias("process_id"), F.concat(F.lit("Conversation "), "conv_id").alias("title")).distinct()
    return records.loaded_cases(cases, titles, gt_only=True).select("case_id", "label", "expected")


# Skills and processes: one file for each supplier.

def _written_files(rows: DataFrame, tag: str) -> str:
    """A file for each row (name, value), written by the tasks, in a folder name=... below the returned one."""
    return _filled(rows.sparkSession, tag, lambda at: rows.write.partitionBy("name").text(at))


_SKILL = (
    "---\nname: \"skill ", "K", "\"\ndescription: >\n  handles requests of ", "NAME", "\n  and more\nmetadata:\n  process-type: ", "KIND",
    "\n---\n# Steps\n1. Open the form <!-- ord_confirmed: ns", "K", ":apiResource:A", "K", ":v1 -->\n2. Send it to ", "NAME", " <!-- ord_confirmed: ns", "K", ":agent:B", "B", ":v1 -->",
)


def _filled_in(template: tuple[str, ...], **fields: Column) -> Column:
    """The pieces of a template put together, names of fields replaced by their values."""
    return F.concat(*[fields[x].cast("string") if x in fields else F.lit(x) for x in template])


def _skills(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    k = F.col("s_suppkey")
    text = _filled_in(_SKILL, K=k, NAME=F.col("s_name"), KIND=F.when(k % 2 == 1, "cmmn").otherwise("bpmn"), B=k % 3)
    path = _written_files(table(spark, sf_dir, "supplier").select(F.concat(F.lit("skill_"), k).alias("name"), text.alias("value")), "skills")
    return records.skills(spark, path, compat, F.regexp_extract("_metadata.file_path", "name=([^/]+)", 1))


_SKILL_IDS = "['ns' || s_suppkey || ':apiResource:A' || s_suppkey || ':v1', 'ns' || s_suppkey || ':agent:B' || (s_suppkey % 3) || ':v1']"


@query(f"SELECT 'skill_' || s_suppkey AS skill_id, 'skill ' || s_suppkey AS name, 'handles requests of ' || s_name || ' and more' AS description, CASE WHEN s_suppkey % 2 = 1 THEN 'cmmn' ELSE 'bpmn' END AS process_type, {_SKILL_IDS} AS confirmed FROM supplier")
def skill_rows(spark, sf_dir):
    return _skills(spark, sf_dir).select("skill_id", "name", "description", "process_type", "confirmed")


@query("SELECT 'skill_' || s_suppkey AS skill_id, 'bpmn' AS process_type FROM supplier")
def skill_types_compat(spark, sf_dir):
    return _skills(spark, sf_dir, compat=True).select("skill_id", "process_type")


@query(f"SELECT 'skill_' || s_suppkey AS skill_id, CASE WHEN s_suppkey % 4 = 0 THEN ['gt' || s_suppkey] ELSE {_SKILL_IDS} END AS gt_ids FROM supplier")
def skills_enriched(spark, sf_dir):
    """Every fourth process has ids of its own."""
    n = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0")
    enrichment = n.select(F.concat(F.lit("skill_"), "s_suppkey").alias("process_id"), F.array(F.concat(F.lit("gt"), "s_suppkey")).alias("gt_ids"))
    return records.skills_with_enrichment(_skills(spark, sf_dir), enrichment).select("skill_id", "gt_ids")


@query(f"SELECT 'skill_' || s_suppkey AS skill_id, i::INT AS step, CASE i WHEN 1 THEN 'Open the form' ELSE 'Send it to ' || s_name END AS text, [{_SKILL_IDS}[i]] AS ids FROM supplier, range(1, 3) t(i)")
def skill_step_rows(spark, sf_dir):
    return _skills(spark, sf_dir).select("skill_id", F.explode("steps").alias("s")).select("skill_id", "s.step", "s.text", "s.ids")


@query("SELECT 'skill_' || s_suppkey AS process_id, 'true' AS \"S1\", CASE WHEN s_suppkey % 5 = 0 THEN 'false' ELSE 'true' END AS \"S2\", CASE WHEN s_suppkey % 5 = 0 THEN 'skipped' ELSE 'true' END AS \"S3\", CASE WHEN s_suppkey % 5 = 0 THEN 'skipped' WHEN s_suppkey % 7 = 1 THEN 'false' ELSE 'true' END AS \"S4\", s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 1 AS passed, CASE WHEN s_suppkey % 5 = 0 THEN 'S2' WHEN s_suppkey % 7 = 1 THEN 'S4' END AS first_failed FROM supplier")
def validated_skills(spark, sf_dir):
    """Every fifth skill names an id that its process lacks; some leak one outside comments."""
    s = _skills(spark, sf_dir).withColumn("k", F.regexp_extract("skill_id", r"(\d+)", 1).cast("int"))
    gt = F.when(F.col("k") % 5 == 0, F.slice("confirmed", 1, 1)).otherwise(F.col("confirmed"))
    text = F.when(F.col("k") % 7 == 1, F.concat("text", F.lit("see "), F.col("confirmed")[0])).otherwise(F.col("text"))
    return Q.validate_skill(s.select(F.col("skill_id").alias("process_id"), text.alias("text"), gt.alias("gt")))


_PROCESS = (
    "<process name=\"x\" id=\"proc_", "WORD", "_request_", "K", "_v2\">\n<!-- <step id='s0' label='none'/> --><step id=\"s1\" label=\"Check / open\" description=\"Of ", "NAME", " &amp; &lt;others&gt;\" ordId=\"ns", "K", ":apiResource:A", "K",
    ":v1\"/>\n<step ordId='ns", "K", ":agent:B", "K", ":v1' description='Send it' label='Send' id='s2'></step></process>",
)


def _process_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = _filled_in(_PROCESS, WORD=F.when(k % 2 == 1, "hire").otherwise("leave"), K=k, NAME=F.col("s_name"))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), k).alias("name"), text.alias("value"))
    # Every fifth process has an enrichment beside it, which is none.
    extra = rows.filter(F.substring("name", 2, 20).cast("long") % 5 == 0).select(F.concat("name", F.lit("_enrichment")).alias("name"), F.lit("<x/>").alias("value"))
    path = _written_files(rows.unionByName(extra), "processes")
    return records.processes(spark, path, F.regexp_extract("_metadata.file_path", "name=([^/]+)", 1))


@query("SELECT 'p' || s_suppkey AS process_id, CASE WHEN s_suppkey % 2 = 1 THEN 'hire' ELSE 'leave' END || ' request ' || s_suppkey AS title FROM supplier")
def process_titles(spark, sf_dir):
    return _process_files(spark, sf_dir).select("process_id", "title")


@query("SELECT 'p' || s_suppkey AS process_id, i::INT AS step_index, 's' || i AS step_id, CASE i WHEN 1 THEN 'Check / open' ELSE 'Send' END AS label, CASE i WHEN 1 THEN 'Of ' || s_name || ' & <others>' ELSE 'Send it' END AS description, 'ns' || s_suppkey || CASE i WHEN 1 THEN ':apiResource:A' ELSE ':agent:B' END || s_suppkey || ':v1' AS id FROM supplier, range(1, 3) t(i)")
def process_step_rows(spark, sf_dir):
    return records.process_steps(_process_files(spark, sf_dir))


# Writers: what is read back.


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def written_report(spark, sf_dir):
    report = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    path = shared_folder(spark, "report-sink")
    sinks.write_report(report, path)
    sinks.write_report(report, path)
    return spark.read.schema("segment string, n long").json(path)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def appended_log(spark, sf_dir):
    """Even and odd events, appended one after the other."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = shared_folder(spark, "log-sink")
    for part in (0, 1):
        sinks.append_log(e.filter(F.col("event_id") % 2 == part), path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS id, s_name AS name, NULL AS note FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, 'copy' FROM supplier")
def inserted_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return sinks.insert(s, s.select((F.col("id") + 1_000_000).alias("id"), "name", F.lit("copy").alias("note")))


@query("SELECT package_id, any_value(origin) AS origin FROM (SELECT 'P' || s_suppkey AS package_id, 'kept' AS origin FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'P' || s_suppkey, 'added' FROM supplier WHERE s_suppkey % 2 = 1) GROUP BY 1")
def ensured_packages(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("package_id"), (F.col("s_suppkey") % 2).alias("odd"))
    return sinks.ensure(p.filter("odd = 0").select("package_id", F.lit("kept").alias("origin")), p.select("package_id", F.lit("added").alias("origin")))


@query("""WITH v AS (SELECT 0 AS version, s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 1, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0
UNION ALL SELECT 2, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END FROM supplier WHERE (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AND s_suppkey % 5 <> 0)
SELECT version, id, name, true AS overtaken FROM v""")
def table_versions(spark, sf_dir):
    """Three versions of one table: even suppliers, every third upserted, every fifth deleted; a late writer that knows only the first is overtaken."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    root, schema, new = shared_folder(spark, "versions"), s.schema, F.concat(F.lit("new "), "name").alias("name")
    snapshots.change(spark, root, schema, lambda t: t.unionByName(s.filter("id % 2 = 0")))
    snapshots.change(spark, root, schema, lambda t: sinks.upsert(t, s.filter("id % 3 = 0").select("id", new)))
    snapshots.change(spark, root, schema, lambda t: sinks.delete(t, s.filter("id % 5 = 0")))
    late = not snapshots.commit(spark, root, 0, lambda at: s.write.parquet(at))
    versions = [snapshots.read(spark, root, schema, v).select(F.lit(v).alias("version"), "id", "name", F.lit(late).alias("overtaken")) for v in range(snapshots.latest(spark, root) + 1)]
    return versions[0].unionByName(versions[1]).unionByName(versions[2])


_CERTIFIED = "(SELECT o_orderkey AS case_id, o_orderpriority AS mode, count(*) AS n_runs, count(*) FILTER (l_returnflag = 'A') AS n_solved FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def _certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    runs = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("mode"), (F.col("l_returnflag") == "A").alias("solved"))
    return C.certify(runs, "mode")


@query(f"SELECT 'results' AS part, mode || ' ' || count(*) AS line FROM {_CERTIFIED} GROUP BY mode UNION ALL SELECT 'summary', mode || ' ' || count(*) FROM {_CERTIFIED} GROUP BY mode UNION ALL SELECT 'report', '| ' || mode || ' | ' || count(*) || ' | ' || count(*) FILTER (n_solved = 0) || ' |' FROM {_CERTIFIED} GROUP BY mode UNION ALL SELECT 'report', unnest(['| mode | cases | robust |', '|---|---|---|'])")
def certification_files(spark, sf_dir):
    """The three files of a certification report, read back."""
    cases = _certified(spark, sf_dir)
    path = shared_folder(spark, "certification")
    sinks.certification_report(cases, C.summary(cases, "mode").select("mode", "cases", "robust"), path)
    lines = spark.read.schema("case_id long, mode string").json(f"{path}/results").groupBy("mode").agg(F.count(F.lit(1)).alias("cases"))
    line = F.concat_ws(" ", "mode", "cases").alias("line")
    out = lines.select(F.lit("results").alias("part"), line).unionByName(spark.read.schema("mode string, cases long").json(f"{path}/summary").select(F.lit("summary").alias("part"), line))
    return out.unionByName(spark.read.text(f"{path}/report.md").select(F.lit("report").alias("part"), F.col("value").alias("line")))


@query(f"SELECT count(*) AS cases, count(*) FILTER (n_solved = 0) AS robust, round(100.0 * count(*) FILTER (n_solved = 0) / count(*), 1) AS robust_pct, round(avg(round((n_runs - n_solved) / n_runs + 1e-10, 4)) + 1e-10, 4) AS mean_difficulty FROM {_CERTIFIED} WHERE mode IN ('1-URGENT', '2-HIGH')")
def subset_summary(spark, sf_dir):
    """Two priorities together stand for SA and DY."""
    return C.subset_summary(_certified(spark, sf_dir), ("1-URGENT", "2-HIGH"))


@query(CATALOGUE + "SELECT 'document' AS part, namespace AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'log', 'capabilities', count(*) FROM r WHERE len(capabilities) > 0")
def enriched_document_files(spark, sf_dir):
    """Documents by namespace, and the log of what enrichment changed."""
    before = catalogue.resources(_clean(spark, sf_dir))
    after = _resources(spark, sf_dir)
    cols = ["id", "namespace", "title", "capabilities", "use_cases", "groups", "process_next"]
    path = shared_folder(spark, "enriched")
    sinks.enriched_documents(before.select(*cols), after.select(*cols), path)
    docs = spark.read.schema("id string, namespace string").json(f"{path}/documents").groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    log = spark.read.schema("id string, field string").json(f"{path}/log").groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return docs.select(F.lit("document").alias("part"), F.col("namespace").alias("name"), "n").unionByName(log.select(F.lit("log").alias("part"), F.col("field").alias("name"), "n"))


@query("SELECT o_orderpriority AS mode, count(*) AS n, count(DISTINCT o_orderkey) AS cases FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def partitioned_provenance(spark, sf_dir):
    """Provenance by mode in folders of their own."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("mode"))
    path = shared_folder(spark, "provenance-sink")
    sinks.write_partitioned(rows, path, "mode")
    return spark.read.schema("case_id long, mode string").json(path).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("cases"))


@query("SELECT 'there' AS file, count(*) AS n FROM region UNION ALL SELECT 'absent', 0")
def optional_files(spark, sf_dir):
    schema = "r_regionkey int, r_name string"
    path = _filled(spark, "optional", lambda at: table(spark, sf_dir, "region").write.json(at))
    count = lambda p, name: records.or_empty(spark, lambda: records.json_lines(spark, p, schema), schema).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("file"), "n")
    return count(path, "there").unionByName(count(path + "-absent", "absent"))


# Checks of nested items, prompts, and what is missing.


@query("""SELECT 's' || s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'apiResource' ELSE 'integrationDependency' END AS type, s_suppkey % 4 = 2 AS passed,
CASE s_suppkey % 4 WHEN 0 THEN ['resourceDefinitions[1] MISSING required field ''url'''] WHEN 1 THEN ['MISSING aspects (at least one required)'] WHEN 3 THEN ['aspects[1] has no apiResources, eventResources, or dataProducts'] ELSE CAST([] AS VARCHAR[]) END AS errors FROM supplier""")
def validated_items(spark, sf_dir):
    """Definitions without url, dependencies without aspects or with one that has no resources."""
    i = F.col("s_suppkey") % 4
    ref = lambda *x: F.array(*x).cast("array<struct<ordId:string>>")
    full = F.struct(F.array(F.struct(F.lit("x").alias("ordId"))).alias("apiResources"), ref().alias("eventResources"), ref().alias("dataProducts"))
    void = F.struct(ref().alias("apiResources"), ref().alias("eventResources"), ref().alias("dataProducts"))
    maps = F.array(F.create_map(F.lit("type"), F.lit("t"), F.lit("url"), F.lit("u")), F.create_map(F.lit("type"), F.lit("t")))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.when(i == 0, "apiResource").otherwise("integrationDependency").alias("type"), F.when(i == 0, maps).alias("resource_definitions"), F.when(i == 2, F.array(full)).when(i == 3, F.array(full, void)).alias("aspects"))
    return Q.validate_resources(rows, {"apiResource": {"resourceDefinitions_item_required": ["type", "url"]}}).drop("warnings")


@query("""WITH f AS (SELECT c_custkey AS case_id, c_custkey % 5 <> 0 AS a, c_custkey % 7 <> 0 OR c_custkey % 3 = 0 AS b, c_custkey % 3 <> 0 AS c, c_custkey % 11 <> 0 AS d FROM customer)
SELECT case_id, a::VARCHAR AS length, CASE WHEN a THEN b::VARCHAR ELSE 'skipped' END AS no_leak, CASE WHEN a AND b THEN c::VARCHAR ELSE 'skipped' END AS known_ids, CASE WHEN a AND b AND c THEN d::VARCHAR ELSE 'skipped' END AS not_in_skill,
a AND b AND c AND d AS passed, CASE WHEN NOT a THEN 'length' WHEN NOT b THEN 'no_leak' WHEN NOT c THEN 'known_ids' WHEN NOT d THEN 'not_in_skill' END AS first_failed FROM f""")
def validated_prompts(spark, sf_dir):
    """Prompts that are too short, leak the local id of what they expect, expect an unknown id, or one of the skill."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    known = F.concat(F.lit("n:agent:Local"), i, F.lit("x:v1"))
    prompt = F.when(i % 5 == 0, F.lit("  too short       ")).when(i % 7 == 0, F.concat(F.lit("please ask local"), i, F.lit("X about it"))).otherwise(F.lit("a prompt that is long enough"))
    rows = c.select(i.alias("case_id"), prompt.alias("prompt"), F.array(F.when(i % 3 == 0, F.lit("n:agent:Nobody:v1")).otherwise(known)).alias("expected"), F.array(F.when(i % 11 == 0, known).otherwise(F.lit("other"))).alias("skill"))
    return Q.validate_prompts(rows, c.select(known.alias("id")))
