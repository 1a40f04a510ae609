"""Benchmark decontamination by winnowing.

Both sides are cut into words; every k-gram of words is hashed, and in each window of w consecutive k-grams the least
hash is kept as a fingerprint. Two texts that share w + k - 1 words share the fingerprint of that span, so joining the
fingerprints of documents and benchmark loses no span of that length. One pass over the documents joins the fingerprint of every window
and keeps the starts of those that hit; only documents with a hit are read again, to compare the windows at those starts word by word
with those of the items, which extends the hits to exactly the words that stand in common windows. Items shorter than a window are
windows of their own length; their hashes are fingerprints themselves, and only the lengths that occur are looked for.

The words of a window are joined by a space, which no word holds, so equal strings are equal word sequences.

Texts are never shuffled while the fingerprints, and the starts of hits, are few enough to be broadcast (counts
are checked); beyond that fingerprints and texts with hits meet by shuffle.

Defined cases: null and wordless texts and items have no windows; an item's repeated windows and repeated items count
once; equal item_ids are one item; a null item_id is not counted as an item but its windows still hit; rows that share a
doc_id are judged each by its own text (the text is part of the key); other columns are not read.

All expressions are built-in functions of the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

WINDOW, GRAM = 10, 5
#: A benchmark with fewer fingerprints (16 bytes each), or windows (about 100 bytes), than this is sent to every executor; a larger one is joined by shuffle.
BROADCAST_PRINTS, BROADCAST_WINDOWS = 1_000_000, 100_000
#: Starts of hits (8 bytes each) up to which they are sent to the documents, and texts with hits are not shuffled.
BROADCAST_STARTS = 4_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as an array; null: empty."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _indices(n: Column) -> Column:
    """0 to n - 1, empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hash of every run of k word hashes."""
    return F.transform(_indices(F.size(hashes) - k + 1), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def window_minima(hashes: Column, w: int) -> Column:
    """Least hash of every w consecutive ones: the fingerprint of each window, by its start."""
    return F.transform(_indices(F.size(hashes) - w + 1), lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)]))


def fingerprints(words: Column, window: int, gram: int) -> Column:
    """The fingerprint of every window of words."""
    return let(word_hashes(words), lambda h: let(gram_hashes(h, gram), lambda g: window_minima(g, window - gram + 1)))


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(n, fp, content, item_id): each window of each item once, with its length and fingerprint."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    full = w.filter(F.size("words") >= window).select("item_id", "words", F.posexplode(fingerprints(F.col("words"), window, gram)).alias("at", "fp"))
    full = full.select(F.lit(window).alias("n"), "fp", F.array_join(F.slice("words", F.col("at") + 1, window), " ").alias("content"), "item_id")
    short = w.filter(F.size("words") < window).select(F.size("words").alias("n"), F.xxhash64(F.array_join("words", " ")).alias("fp"), F.array_join("words", " ").alias("content"), "item_id")
    return full.unionByName(short).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated): items is the sorted array of item_ids, as strings, whose windows occur."""
    return text_contamination(docs, items, window, gram).drop("crc")


def text_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The same with crc, the xxhash64 of the text that the row is about."""
    if window <= gram:
        raise ValueError("a window must be longer than a gram")
    run = Scratch(docs.sparkSession, "op3")
    known = run.write(item_windows(items.select("item_id", "text"), window, gram), "windows")
    lengths = sorted(r.n for r in known.select("n").distinct().collect())
    prints = known.select(F.col("n").alias("_n"), F.col("fp").alias("_fp")).distinct()
    if prints.count() <= BROADCAST_PRINTS:
        prints = F.broadcast(prints)
    docs = docs.select("doc_id", F.xxhash64("text").alias("crc"), "text")

    def prints_of(words: Column, n: int) -> Column:
        """The fingerprints of the windows of n words, by their starts."""
        return fingerprints(words, window, gram) if n == window else F.transform(_indices(F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, n), " ")))

    def marks_of(words: Column) -> Column:
        """A first entry with the number of words, then every window."""
        head = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("fp"), F.size(words).alias("at")))
        return F.concat(head, *[F.transform(prints_of(words, n), marker(n)) for n in lengths])

    def marker(n: int) -> Callable[[Column, Column], Column]:
        return lambda x, i: F.struct(F.lit(n).alias("n"), x.alias("fp"), i.alias("at"))

    seen = docs.select("doc_id", "crc", F.explode(let(words_of(F.col("text")), marks_of)).alias("m")).select("doc_id", "crc", "m.n", "m.fp", "m.at")
    met = seen.join(prints, (F.col("n") == F.col("_n")) & (F.col("fp") == F.col("_fp")), "left").filter("n = 0 OR _n IS NOT NULL")
    met = run.write(met.select("doc_id", "crc", "n", "at"), "met")
    rows = met.filter("n = 0").select("doc_id", "crc", F.col("at").cast("long").alias("n_words"))
    hits = run.write(met.filter("n > 0").groupBy("doc_id", "crc").agg(F.collect_set(F.struct("at", "n")).alias("starts")), "hits")
    sent = hits.withColumnsRenamed({"doc_id": "_id", "crc": "_crc"})
    if (hits.agg(F.sum(F.size("starts"))).first()[0] or 0) <= BROADCAST_STARTS:
        sent = F.broadcast(sent)

    def opened(words: Column) -> Column:
        return F.transform("starts", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.array_join(F.slice(words, s["at"] + 1, s["n"]), " ").alias("content")))

    asked = docs.join(sent, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc")))
    open_windows = asked.select("doc_id", "crc", F.explode(let(words_of(F.col("text")), opened)).alias("w")).select("doc_id", "crc", "w.at", "w.n", "w.content")
    by_window = known.groupBy("content").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    if known.count() <= BROADCAST_WINDOWS:
        by_window = F.broadcast(by_window)
    true = open_windows.join(by_window, "content")
    per_doc = true.groupBy("doc_id", "crc").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    # Spans in order of their starts: each adds what lies behind the furthest end so far.
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), lambda acc, s: F.struct(F.greatest(acc["end"], s["at"] + s["n"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(acc["end"], s["at"]))).alias("sum")), lambda acc: acc["sum"])
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), covered.cast("long").alias("n_hit"), "items")
    out = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc")), "left")
    return out.select("doc_id", "crc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
it AS (SELECT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS c FROM iw WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM it),
do_ AS (SELECT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: {'st': i, 'c': array_to_string(ws[i:i + n - 1], ' ')})) AS w FROM dw, ns WHERE len(ws) >= n),
h AS MATERIALIZED (SELECT d.doc_id, d.w.st AS st, d.n, i.item_id FROM do_ d JOIN it i ON d.w.c = i.c AND d.n = i.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(st, st + n)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON hw.doc_id = dw.doc_id LEFT JOIN hi ON hi.doc_id = dw.doc_id
"""
