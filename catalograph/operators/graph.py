"""The graph of a catalogue: nodes (id, label, kind, namespace), edges (source, target, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import id_segment
from ..schema import TAXONOMY_NAMESPACE


def edges_of(resources: DataFrame, kind: str, ids: str, prefix: str) -> DataFrame:
    ends = resources.select("id", F.explode(ids).alias("end"))
    return ends.select(F.concat(F.lit("res:"), "id").alias("source"), F.concat(F.lit(prefix), "end").alias("target"), F.lit(kind).alias("kind"))


def landscape_graph(resources: DataFrame, steps: DataFrame | None = None, calls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree, edges). resources: seq, id, namespace, type, title, entity_types, process_next; steps: (process_id, id); calls: (agent_id, target_id).

    The first node of an id wins (systems, resources, entity types, processes, each by seq); edges keep repeats; edges with
    an unknown end go.
    """
    res = resources.filter((F.col("namespace") != TAXONOMY_NAMESPACE) & (F.col("type") != "entityType"))
    sys_id, res_id = F.concat(F.lit("sys:"), "namespace"), F.concat(F.lit("res:"), "id")
    node = lambda df, *c: df.select(*[x.alias(n) for x, n in zip(c, ("id", "label", "kind", "namespace", "part", "seq"))])
    kinds = res.select("seq", F.explode("entity_types").alias("et"))
    nodes = node(res, sys_id, F.col("namespace"), F.lit("system"), F.col("namespace"), F.lit(0), F.col("seq"))
    nodes = nodes.unionByName(node(res, res_id, F.col("title"), F.col("type"), F.col("namespace"), F.lit(1), F.col("seq")))
    nodes = nodes.unionByName(node(kinds, F.concat(F.lit("et:"), "et"), F.coalesce(id_segment(F.col("et"), 2), F.col("et")), F.lit("entityType"), F.lit(None).cast("string"), F.lit(2), F.col("seq")))
    edges = res.select(sys_id.alias("source"), res_id.alias("target"), F.lit("hosts").alias("kind")).unionByName(edges_of(res, "entities", "entity_types", "et:")).unionByName(edges_of(res, "processNext", "process_next", "res:"))
    if steps is not None:
        group = F.concat(F.lit("group:"), "process_id")
        nodes = nodes.unionByName(node(steps, group, F.col("process_id"), F.lit("process"), F.lit(None).cast("string"), F.lit(3), F.lit(0).cast("long")))
        edges = edges.unionByName(steps.select(res_id.alias("source"), group.alias("target"), F.lit("partOfGroups").alias("kind")))
    if calls is not None:
        edges = edges.unionByName(calls.select(F.concat(F.lit("res:"), "agent_id").alias("source"), F.concat(F.lit("res:"), "target_id").alias("target"), F.lit("calls").alias("kind")))
    first = F.row_number().over(Window.partitionBy("id").orderBy("part", "seq"))
    nodes = nodes.distinct().withColumn("_n", first).filter("_n = 1").drop("_n", "part", "seq")
    edges = drop_dangling(edges, nodes)
    return nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long")), edges


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def kind_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n)."""
    count = lambda df, what: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def visible(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], structural: tuple[str, ...] = ("system", "entityType", "process")) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under a filter of edge kinds: resources need an edge of an active kind; edges need both ends visible."""
    active = edges.filter(F.col("kind").isin(*kinds))
    touched = active.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    shown = nodes.filter(F.col("kind").isin(*structural)).unionByName(nodes.filter(~F.col("kind").isin(*structural)).join(touched, "id", "left_semi"))
    return shown, drop_dangling(active, shown)


def neighbourhood(edges: DataFrame, node_id: str) -> DataFrame:
    """Ids one edge away from a node."""
    near = edges.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    return near.select(F.when(F.col("source") == node_id, F.col("target")).otherwise(F.col("source")).alias("id")).distinct()


def entity_usage(resources: DataFrame) -> DataFrame:
    """(entity_type, n, namespaces): resources that use it; order by n descending, then name, to rank."""
    return resources.select("id", "namespace", F.explode("entity_types").alias("entity_type")).distinct().groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("namespace").alias("namespaces"))


def incoming_relations(entities: DataFrame) -> DataFrame:
    """(id, incoming): entity types that name this one as related, itself excepted. entities: (id, related[])."""
    out = entities.select(F.col("id").alias("source"), F.explode("related").alias("id")).filter("source <> id")
    return out.join(entities.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("incoming"))


def agent_calls(dependencies: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, target_id): a dependency `...:integrationDependency:<local>-to-...` belongs to the agent of its system with that local id, in lower case.

    dependencies: (namespace, id, aspects); agents: (namespace, id).
    """
    a = agents.select("namespace", F.col("id").alias("agent_id"), F.lower(id_segment(F.col("id"), 2)).alias("_k"))
    local = F.nullif(F.lower(F.regexp_extract("id", ":integrationDependency:([^:]+)-to-", 1)), F.lit(""))
    d = dependencies.select("namespace", local.alias("_k"), F.explode("aspects").alias("x"))
    refs = F.flatten(F.array(*[F.coalesce(F.transform(F.col(f"x.{c}"), lambda t: t["ordId"]), F.array().cast("array<string>")) for c in ("apiResources", "eventResources", "dataProducts")]))
    return d.join(a, ["namespace", "_k"]).select("agent_id", F.explode(refs).alias("target_id")).filter("target_id IS NOT NULL").distinct()


def resolve_targets(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """refs (ref) with what the catalogue knows of them, else what the id itself says and known = false."""
    r = resources.select(F.col("id").alias("_id"), F.col("title").alias("_t"), F.col("type").alias("_y"), F.col("namespace").alias("_n"))
    j = refs.join(r, F.col("ref") == F.col("_id"), "left")
    return j.select("ref", F.coalesce("_t", id_segment(F.col("ref"), 2), F.col("ref")).alias("title"), F.coalesce("_y", id_segment(F.col("ref"), 1)).alias("type"), F.coalesce("_n", id_segment(F.col("ref"), 0)).alias("namespace"), F.col("_id").isNotNull().alias("known"))
