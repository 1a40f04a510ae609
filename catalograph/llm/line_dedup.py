"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines over the threshold, reassemble.

Only hashes, ids and positions are shuffled for the counting; texts move once, to meet the positions to drop.
A line that a third of all documents hold is pre-aggregated by every task before the shuffle. To learn which document
keeps a line, lines with more than one in HOT_SHARE of all shared lines (fewer than HOT_SHARE of them, whatever the input) are
broadcast, and their rows are spread over the join by their own position; all others meet their keeper by the hash.

Defined cases: a null or empty text is one empty line; keys shorter than `min_chars` code points never count;
a line repeated inside its keeping document stays there each time; rows that share a doc_id are one document to
the count, and each is filtered by the positions of its own lines (rows are told apart by doc_id and a hash of the text); null
doc_ids form one document that sorts after all others; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

TRIM = " \t\n\x0b\x0c\r"
HOT_SHARE = 1000


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(TRIM)))


def lines_of(text: Column) -> Column:
    """The lines of a text; null counts as empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _shared_lines(keyed: DataFrame, min_docs: int) -> DataFrame:
    """(_h1, _h2, _keeper, _n): the lines that enough documents hold, the least of them, and their rows."""
    n = F.count(F.lit(1)).alias("_n")
    if min_docs == 2:
        counted = keyed.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_keeper"), F.max("doc_id").alias("_last"), F.bool_or(F.col("doc_id").isNull()).alias("_void"), n)
        shared = counted.filter((F.col("_keeper") < F.col("_last")) | (F.col("_void") & F.col("_keeper").isNotNull()))
    else:
        counted = keyed.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_keeper"), (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("_docs"), n)
        shared = counted.filter(F.col("_docs") >= min_docs)
    return shared.select("_h1", "_h2", "_keeper", "_n")


def duplicate_positions(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, _crc, _drop): for each document and text with something to drop, the positions of those lines, unordered."""
    exploded = docs.select("doc_id", F.xxhash64("text").alias("_crc"), F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line")).select("doc_id", "_crc", "_pos", line_key(F.col("_line")).alias("_key"))
    keyed = exploded.filter(F.char_length("_key") >= min_chars).select("doc_id", "_crc", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), F.col("_key")).alias("_h2"))
    shared = Scratch(docs.sparkSession, "op9").write(_shared_lines(keyed, min_docs), "shared")
    total = shared.agg(F.sum("_n")).first()[0] or 0
    hot, rest = shared.filter(F.col("_n") * HOT_SHARE > total), shared.filter(F.col("_n") * HOT_SHARE <= total)
    hot = F.broadcast(hot.select(F.col("_h1").alias("_hot1"), F.col("_h2").alias("_hot2"), F.struct("_keeper").alias("_hot")))
    rest = rest.select(F.col("_h1").alias("_rest1"), F.col("_h2").alias("_rest2"), F.struct("_keeper").alias("_rest"))
    met = keyed.join(hot, (F.col("_h1") == F.col("_hot1")) & (F.col("_h2") == F.col("_hot2")), "left")
    # Rows of a hot line need no partner: they are dealt by themselves.
    met = met.withColumn("_to", F.when(F.col("_hot").isNull(), F.col("_h1")).otherwise(F.xxhash64("doc_id", "_crc", "_pos")))
    met = met.join(rest, (F.col("_to") == F.col("_rest1")) & (F.col("_h2") == F.col("_rest2")), "left")
    keeper = F.coalesce("_hot", "_rest")
    hits = met.filter(keeper.isNotNull() & ~F.col("doc_id").eqNullSafe(keeper["_keeper"]))
    return hits.groupBy("doc_id", "_crc").agg(F.collect_set("_pos").alias("_drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row of docs."""
    rows = docs.select("doc_id", "text")
    drop = duplicate_positions(rows, min_chars, min_docs).withColumnsRenamed({"doc_id": "_id", "_crc": "_id_crc"})
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("_drop").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop")), lambda i: F.get(F.col("_lines"), i)), "\n")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_id_crc"))
    joined = rows.join(drop, same, "left").withColumn("_lines", lines)
    return joined.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the line dedup of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, u.pos AS pos, u.line AS line, translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(range(len(ls)), lambda i: {'pos': i, 'line': ls[i + 1]})) AS u
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
d AS (SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, l.pos, l.line, d.k IS NOT NULL AND l.doc_id <> d.keeper AS gone FROM l LEFT JOIN d ON l.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
