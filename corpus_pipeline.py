"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns that docs has, in that order; run() writes each result as Parquet into the shared folder and reads it back
as the next stage's docs. Rows with null texts or ids, empty tables, repeated rows and extra columns pass as each operator
in catalograph/llm defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalograph.llm import decontamination, language_id, mixing, ngram_join, sharding
from catalograph.llm.common import Scratch, fresh_name, id_text_crc

N_SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a language: those without any letter (`und`) go."""
    model = language_id.train(docs, id_text_crc(F.col("doc_id")) % 4 != 2)
    return docs.filter(language_id.predicted_language(model, F.col("text")) != language_id.NONE)


def _at(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join of docs with keys (doc_id, crc), crc the hash of the text: rows that share a doc_id are told apart, null ones too."""
    i, crc = fresh_name(docs.columns, "_at_id"), fresh_name(docs.columns, "_at_crc")
    keys = keys.select(F.col("doc_id").alias(i), F.col("crc").alias(crc))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(crc)), how)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: one of its smallest doc_id (null last). Texts without shingles form no group and all stay."""
    texts = Scratch(spark, "pipeline-texts").write(ngram_join.component_texts(docs), "texts")
    rest = _at(docs, texts.filter("NOT first OR n_rows > 1"), "left_anti")
    # Repeated rows of a text that stays: one of them.
    crc = fresh_name(docs.columns, "_crc")
    repeated = _at(docs, texts.filter("first AND n_rows > 1"), "left_semi").withColumn(crc, F.xxhash64("text")).dropDuplicates(["doc_id", crc])
    return rest.unionByName(repeated.select(*docs.columns)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of a benchmark item occurs."""
    found = decontamination.text_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _at(docs, found.filter("contaminated").select("doc_id", "crc").distinct(), "left_anti").select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; 0 copies drop it."""
    return mixing.mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their virtual slot and shard, under a map balanced for their bytes."""
    return sharding.shard_documents(docs, N_SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
    ("sharding", assign_shards),
]

#: No SQL: languages, mix and slot map come from models and iterations. tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, last = Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        if last:
            tables.delete(last)
        last = name
    return docs
