"""Readers of catalogue documents: <root>/systems/<namespace>/ord.json, <root>/systems_enriched/<namespace>/ord_enriched.json."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import entity_types_for_loading, entity_types_for_metric, group_ids, strings
from ..schema import DOCUMENT, TAXONOMY_NAMESPACE, TYPED_ARRAYS


def documents(spark: SparkSession, path: str, namespace: Column | None = None, piece: Column | None = None) -> DataFrame:
    """(namespace, piece, document columns): one row per file; the namespace is the name of its folder. A large system may come in several documents, in order of `piece`."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumns({"namespace": namespace if namespace is not None else folder, "piece": piece if piece is not None else F.lit(0).cast("long")})


def with_fallback(enriched: DataFrame | None, clean: DataFrame) -> DataFrame:
    """The enriched document of each namespace, else the clean one."""
    if enriched is None:
        return clean
    return enriched.unionByName(clean.join(enriched.select("namespace").distinct(), "namespace", "left_anti"), allowMissingColumns=True)


def packages(docs: DataFrame) -> DataFrame:
    """(namespace, package_id, title, line_of_business, vendor, tags), the last of equal ids."""
    p = docs.select("namespace", "piece", F.posexplode("packages").alias("pos", "p")).select("namespace", "piece", "pos", F.col("p.ordId").alias("package_id"), F.col("p.title").alias("package_title"), F.col("p.lineOfBusiness").alias("package_lob"), F.col("p.vendor").alias("vendor"), F.col("p.tags").alias("package_tags"))
    last = F.row_number().over(Window.partitionBy("namespace", "package_id").orderBy(F.col("piece").desc(), F.col("pos").desc()))
    return p.withColumn("_n", last).filter("_n = 1").drop("_n", "piece", "pos")


def resources(docs: DataFrame, raw: bool = False, skip_taxonomy: bool = True, inherit_empty: bool = True) -> DataFrame:
    """The resource relation: five typed arrays flattened in load order, with package fields.

    raw: the metric's reading of entity types and no inheritance of lines of business; otherwise the loader's reading,
    where an empty list inherits from the package (inherit_empty; else only a missing one does).
    """
    kept = docs.filter(F.col("namespace") != TAXONOMY_NAMESPACE) if skip_taxonomy else docs
    parts = [kept.select("namespace", "piece", F.lit(k).alias("_k"), F.lit(kind).alias("type"), F.posexplode(array).alias("_pos", "e")) for k, (array, kind) in enumerate(TYPED_ARRAYS)]
    flat = reduce(DataFrame.unionByName, parts)
    text = lambda f: F.coalesce(F.col(f"e.{f}"), F.lit(""))
    kinds = entity_types_for_metric(F.col("e.relatedEntityTypes"), F.col("e.exposedEntityTypes"), F.col("e.entityTypes")) if raw else entity_types_for_loading(F.col("e.entityTypeMappings"), F.col("e.exposedEntityTypes"), F.col("e.relatedEntityTypes"), F.col("e.entityTypes"))
    rows = flat.join(packages(kept).withColumnRenamed("namespace", "_pns"), (F.col("namespace") == F.col("_pns")) & (F.col("e.partOfPackage") == F.col("package_id")), "left")
    lob = F.col("e.lineOfBusiness")
    own = F.when(F.size(lob) > 0, lob) if inherit_empty else lob
    return rows.select(
        # Load order: namespaces sorted, then arrays, documents, position; unique without numbering all rows.
        F.xxhash64("namespace", "_k", "piece", "_pos").alias("seq"),
        F.struct("namespace", "_k", F.col("piece").alias("_piece"), "_pos").alias("load_order"),
        text("ordId").alias("id"),
        "namespace",
        "type",
        text("title").alias("title"),
        text("shortDescription").alias("short_description"),
        text("description").alias("description"),
        F.col("e.localId").alias("local_id"),
        kinds.alias("entity_types"),
        text("partOfPackage").alias("part_of_package"),
        F.coalesce("package_title", F.lit("")).alias("package_title"),
        strings(lob if raw else F.coalesce(own, F.col("package_lob"))).alias("line_of_business"),
        strings(F.col("e.partOfProducts")).alias("part_of_products"),
        strings(F.col("e.tags")).alias("tags"),
        strings(F.col("e.industry") if raw else F.lit(None).cast("array<string>")).alias("industry"),
        strings(F.col("e.capabilities")).alias("capabilities"),
        strings(F.col("e.useCases")).alias("use_cases"),
        strings(group_ids(F.col("e.partOfGroups"))).alias("groups"),
        strings(F.col("e.processNext")).alias("process_next"),
        text("apiProtocol").alias("api_protocol"),
        text("responsible").alias("responsible"),
        F.col("e.visibility").alias("visibility"),
        F.col("e.releaseStatus").alias("release_status"),
        F.col("e.resourceDefinitions").alias("resource_definitions"),
    )


def number(resources_: DataFrame) -> DataFrame:
    """seq replaced by the ordinal of the load order: the position in its array, behind all arrays before it (a row for each system, array and document)."""
    at = ("namespace", "_k", "_piece")
    arrays = resources_.groupBy(*[F.col(f"load_order.{c}").alias(f"_at{c}") for c in at]).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*[f"_at{c}" for c in at]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = arrays.select(*[f"_at{c}" for c in at], before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*[f"load_order.{c}" for c in at]).orderBy("load_order._pos")) - 1
    same = [F.col(f"load_order.{c}") == F.col(f"_at{c}") for c in at]
    numbered = resources_.withColumn("_rank", rank).join(behind, same)
    return numbered.withColumn("seq", (F.col("_before") + F.col("_rank")).cast("long")).drop("load_order", "_rank", "_before", *[f"_at{c}" for c in at])


def package_titles(docs: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """(namespace, package_id, title): the given title of the system, else the package's own, else the namespace."""
    given = F.create_map(*[F.lit(x) for kv in (titles or {}).items() for x in kv]) if titles else None
    own = [F.try_element_at(given, F.col("namespace"))] if titles else []
    return packages(docs).select("namespace", "package_id", F.coalesce(*own, "package_title", "namespace").alias("title"))


def entity_types(docs: DataFrame) -> DataFrame:
    """The entity catalogue of the taxonomy: (id, title, description, package_title, related[])."""
    rows = docs.filter(F.col("namespace") == TAXONOMY_NAMESPACE).select("namespace", F.explode("entityTypes").alias("e"))
    p = packages(docs).select(F.col("namespace").alias("_pns"), "package_id", "package_title")
    j = rows.join(p, (F.col("namespace") == F.col("_pns")) & (F.col("e.partOfPackage") == F.col("package_id")), "left")
    empty = F.lit(None).cast("string")
    return j.select(F.col("e.ordId").alias("id"), F.col("e.title").alias("title"), F.col("e.description").alias("description"), "package_title", entity_types_for_metric(F.col("e.relatedEntityTypes"), empty, empty).alias("related"))


def entity_ids(docs: DataFrame) -> DataFrame:
    return entity_types(docs).select("id").distinct()


def dependencies(docs: DataFrame) -> DataFrame:
    return docs.select("namespace", F.explode("integrationDependencies").alias("d")).select("namespace", F.col("d.ordId").alias("id"), F.col("d.title").alias("title"), F.col("d.aspects").alias("aspects"))


def of_type(resources_: DataFrame, namespace: str, kind: str) -> DataFrame:
    """Ids of one type that a system already has."""
    return resources_.filter((F.col("namespace") == namespace) & (F.col("type") == kind)).select("id")


def by_id(resources_: DataFrame, ord_id: str) -> DataFrame:
    """The first resource with an id, by seq."""
    return resources_.filter(F.col("id") == ord_id).orderBy("seq").limit(1)


def of_ids(lists: DataFrame, resources_: DataFrame, ids: str = "ids") -> DataFrame:
    """The resources of lists of ids (with the other columns of `lists` and the position in the list); unknown ids are dropped."""
    rows = lists.select(*[c for c in lists.columns if c != ids], F.posexplode(ids).alias("position", "id"))
    return rows.join(resources_, "id")


def grouped(resources_: DataFrame, *by: str) -> DataFrame:
    """The ids of each group in order, and their number: by type within a system, or by namespace for usages."""
    return resources_.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("n"))


def titled_order(rows: DataFrame, title: str, within: str) -> DataFrame:
    """rows numbered from 1 by title in the order of its locale, inside each value of `within`."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(within).orderBy(F.collate(F.col(title), "UNICODE"))))


def ground_truth(resources_: DataFrame, eligible: DataFrame) -> DataFrame:
    """Resources whose seq is among the eligible ones."""
    return resources_.join(eligible.select("seq"), "seq", "left_semi")
