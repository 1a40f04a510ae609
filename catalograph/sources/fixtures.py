"""Stand-ins for the relations of a catalogue over generic tables, for the registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A prime by which ids are spread over the parts.
SPREAD = 7919


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resource relation from documents and part: whole texts; ids are spread over all parts, and the part's name is the use case of an enriched one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # The number of parts is one row.
    n_parts = part.agg(F.max("p_partkey").alias("n_parts"))
    spread = docs.crossJoin(F.broadcast(n_parts)).withColumn("part_of", F.col("doc_id") * SPREAD % (F.col("n_parts") + 1))
    d = spread.join(part, F.col("p_partkey") == F.col("part_of"), "left").withColumn("p_name", F.coalesce("p_name", F.lit("")))
    i = F.col("doc_id")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    kind = F.when(F.col("lang") == "en", "apiResource").when(F.col("lang") == "fr", "agent").when(F.col("lang") == "de", "dataProduct").otherwise("entityType")
    name = lambda prefix, n: F.concat(F.lit(prefix), (i % n).cast("string"))
    none = F.array().cast("array<string>")
    enriched = i % 4 == 1
    some = lambda c: F.when(enriched, F.array(c)).otherwise(none)
    local = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")
    return d.select(
        i.alias("seq"),
        i.cast("string").alias("id"),
        name("sys", 7).alias("namespace"),
        kind.alias("type"),
        F.array_join(words, " ").alias("text"),
        local.alias("local_id"),
        F.array(name("E", 20), name("F", 10)).alias("entity_types"),
        F.array(name("L", 5)).alias("line_of_business"),
        F.array(name("T", 10), F.concat(F.lit("U"), (F.col("n_chars") % 3).cast("string"))).alias("tags"),
        F.when(i % 4 == 0, F.array(name("I", 8))).otherwise(none).alias("industry"),
        enriched.alias("enriched"),
        some(name("C", 9)).alias("capabilities"),
        some(name("G", 6)).alias("groups"),
        F.when(enriched, F.col("p_name")).otherwise("").alias("use_case_text"),
        some((i + 4).cast("string")).alias("process_next"),
    )


#: The same view in SQL, as common table expressions.
ASSETS_SQL = rf"""
words AS (SELECT doc_id, lang, n_chars, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
asset AS (SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS id, 'sys' || (doc_id % 7) AS namespace,
  CASE lang WHEN 'en' THEN 'apiResource' WHEN 'fr' THEN 'agent' WHEN 'de' THEN 'dataProduct' ELSE 'entityType' END AS type,
  array_to_string(ws, ' ') AS text, array_to_string(list_transform(string_split(coalesce(p_name, ''), ' '), lambda w: upper(w[1]) || w[2:]), '') AS local_id,
  ['E' || (doc_id % 20), 'F' || (doc_id % 10)] AS entity_types, ['L' || (doc_id % 5)] AS line_of_business, ['T' || (doc_id % 10), 'U' || (n_chars % 3)] AS tags,
  CASE WHEN doc_id % 4 = 0 THEN ['I' || (doc_id % 8)] ELSE CAST([] AS VARCHAR[]) END AS industry, doc_id % 4 = 1 AS enriched,
  CASE WHEN doc_id % 4 = 1 THEN ['C' || (doc_id % 9)] ELSE CAST([] AS VARCHAR[]) END AS capabilities,
  CASE WHEN doc_id % 4 = 1 THEN ['G' || (doc_id % 6)] ELSE CAST([] AS VARCHAR[]) END AS groups,
  CASE WHEN doc_id % 4 = 1 THEN coalesce(p_name, '') ELSE '' END AS use_case_text,
  CASE WHEN doc_id % 4 = 1 THEN [CAST(doc_id + 4 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS process_next
  FROM words LEFT JOIN (SELECT p_partkey, p_name FROM part) ON p_partkey = doc_id * {SPREAD} % ((SELECT max(p_partkey) FROM part) + 1))
"""
