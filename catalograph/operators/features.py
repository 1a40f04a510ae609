"""Features of resources as long tables (id, key, weight), with the sizes and norms that the pair kernels need.

resources: seq, namespace, type, text, local_id, entity_types, line_of_business, tags, industry, and for the extended
metric capabilities, groups, use_case_text. seq is unique.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import strings
from ..functions.text import local_id_tokens
from ..schema import STOP_WORDS

_TOKEN = re.compile("[a-z0-9]{3,}")

#: The set-valued dimensions and the columns they come from.
SETS = {"localId": "local_tokens", "entityTypes": "entity_types", "lineOfBusiness": "line_of_business", "tags": "tags", "industry": "industry"}


def scored(resources: DataFrame, exclude: tuple[str, ...] = ("entityType",)) -> DataFrame:
    """Resources that take part in scoring, with token sets and distinct arrays."""
    ord_id = F.col("id") if "id" in resources.columns else F.lit(None).cast("string")
    out = resources.filter(~F.coalesce("type", F.lit("")).isin(*exclude)).withColumn("local_tokens", local_id_tokens(F.col("local_id"), ord_id))
    for c in ("entity_types", "line_of_business", "tags", "industry", "capabilities", "groups"):
        if c in resources.columns:
            out = out.withColumn(c, F.array_distinct(strings(F.col(c))))
    return out


def term_counts(resources: DataFrame, text: str = "text") -> DataFrame:
    """(seq, length, terms, counts): the tokens of a text, how many they are, each distinct one once with its count.

    A text is counted where it lies, in Arrow batches: no row for each token, and no shuffle. The tokens are those of tokenize().
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = frozenset(STOP_WORDS)
        for batch in batches:
            found = [Counter(t for t in _TOKEN.findall(x or "") if t not in stop) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([c.total() for c in found], pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["seq", "length", "terms", "counts"])

    return resources.select(F.col("seq").cast("long").alias("seq"), F.lower(F.col(text)).alias("text")).mapInArrow(count, "seq long, length long, terms array<string>, counts array<long>")


def tfidf(resources: DataFrame, text: str = "text") -> DataFrame:
    """(seq, term, tf, idf, weight): tf = count / length, idf = ln((N + 1) / (df + 1)). N counts all resources, empty texts too."""
    # Texts are dealt out first: a file of one row group would be counted by one task. Both uses of the counts read this exchange.
    counted = term_counts(resources.select("seq", text).repartition("seq"), text)
    total = resources.agg(F.count(F.lit(1)).alias("n_docs"))
    return weighted(counted, total)


def weighted(counted: DataFrame, total: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """(seq, term, tf, idf, weight) of term counts. total: one row with n_docs; df: (term, df), counted here if not given."""
    counts = counted.select("seq", "length", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("seq", "length", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if df is None else df
    # The total is one row.
    out = counts.join(df, "term").crossJoin(F.broadcast(total))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1))
    return out.select("seq", "term", (F.col("n") / F.col("length")).alias("tf"), idf.alias("idf"), (F.col("n") / F.col("length") * idf).alias("weight"))


def text_vectors(resources: DataFrame, text: str = "text") -> DataFrame:
    """(seq, terms, weights): hashes of the terms and weights divided by the norm, so that a sum of products is the cosine. Terms of weight 0 and texts without others are left out."""
    return normalised(tfidf(resources, text))


def hashed_counts(resources: DataFrame, text: str = "text") -> DataFrame:
    """term_counts() with the hashes of the terms, as text_vectors() has them."""
    counted = term_counts(resources.select("seq", text).repartition("seq"), text)
    return counted.withColumn("terms", F.transform("terms", lambda t: F.xxhash64(t)))


def normalised(weights: DataFrame, hashed: bool = False) -> DataFrame:
    """text_vectors() of weighted terms, or of hashes of terms."""
    term = F.col("term") if hashed else F.xxhash64("term")
    terms = weights.filter("weight <> 0").select("seq", F.struct(term.alias("term"), "weight").alias("t"))
    got = terms.groupBy("seq").agg(F.array_sort(F.collect_list("t")).alias("t"), F.sqrt(F.sum(F.col("t.weight") * F.col("t.weight"))).alias("norm"))
    return got.filter("norm > 0").select("seq", F.col("t.term").alias("terms"), F.transform("t", lambda x: x["weight"] / F.col("norm")).alias("weights"))


def norms(terms: DataFrame) -> DataFrame:
    """(seq, norm) over all own terms."""
    return terms.groupBy("seq").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def entity_idf(resources: DataFrame) -> DataFrame:
    """(entity_type, n, idf): 1 / ln(1 + n), n counts resources."""
    return resources.select("seq", F.explode(F.array_distinct(strings(F.col("entity_types")))).alias("entity_type")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).withColumn("idf", 1 / F.log(1.0 + F.col("n")))


def set_features(resources: DataFrame, dims: dict[str, str] = SETS) -> DataFrame:
    """(seq, dim, key, weight): 1 for every value of a set, the rarity of entity types."""
    entries = F.concat(*[_entries(dim, F.col(c)) for dim, c in dims.items()])
    long = resources.select("seq", F.explode(entries).alias("e")).select("seq", "e.dim", "e.key")
    if "entityTypes" not in dims:
        return long.withColumn("weight", F.lit(1.0))
    idf = entity_idf(resources).select(F.lit("entityTypes").alias("dim"), F.col("entity_type").alias("key"), "idf")
    return long.join(idf, ["dim", "key"], "left").select("seq", "dim", "key", F.coalesce("idf", F.lit(1.0)).alias("weight"))


def _entries(dim: str, values: Column) -> Column:
    return F.transform(values, lambda k: F.struct(F.lit(dim).alias("dim"), k.alias("key")))


def text_features(resources: DataFrame, text: str = "text", dim: str = "text") -> DataFrame:
    """(seq, dim, key, weight) with weights divided by the norm: a sum of products is the cosine. Terms of weight 0 are left out."""
    terms = tfidf(resources, text)
    return terms.join(norms(terms), "seq").filter("weight <> 0 AND norm > 0").select("seq", F.lit(dim).alias("dim"), F.col("term").alias("key"), (F.col("weight") / F.col("norm")).alias("weight"))
