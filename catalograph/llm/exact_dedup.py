"""Exact dedup by Grace hashing.

Records are partitioned by a hash of their normalised text into buckets; every bucket goes through one open-addressing
table that compares complete contents. A table takes `table_bytes` of distinct contents and their entries at most. What does not fit is
written to the shared folder as the spill of that bucket and partitioned again, by other bits of the hash and into more
buckets, until nothing is left over. Contents already in a table still absorb their copies after it is full, so copies
never spill, and every task first combines the copies it holds, so that a group of copies of any size reaches its
bucket as a few records.

Defined cases: null counts as empty; of equal texts the row with the most code points stays, then the smallest doc_id
(null last); rows with the same doc_id and text are the same record and share `kept`; other columns are not read. Buckets that
do not fit after LEVELS partitionings are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, Scratch, shuffle_partitions
from .wordgrams import lean, text_slices

TABLE_BYTES = 48 << 20
#: What an entry of a table takes beside its content.
ENTRY_BYTES = 450
LEVELS = 64
LONGEST = 1 << 62
_RECORD = pa.schema([("sha", pa.binary()), ("content", pa.binary()), ("n", pa.int64()), ("chars", pa.int64()), ("doc_id", pa.int64())])
_RECORD_SQL = "sha binary, content binary, n long, chars long, doc_id long"


class OpenTable:
    """Open addressing with linear probing; an entry is [hash, content, count, chars, doc_id, sha]. It doubles at half load."""

    def __init__(self, limit: int = LONGEST, entry_bytes: int = 0):
        self.slots: list[int] = [-1] * 1024
        self.entries: list[list] = []
        self.bytes, self.limit, self.entry_bytes = 0, limit, entry_bytes

    def _free(self, h: int) -> int:
        mask = len(self.slots) - 1
        i = h & mask
        while self.slots[i] >= 0:
            i = (i + 1) & mask
        return i

    def add(self, sha: bytes, content: bytes, n: int, chars: int, doc_id: int | None) -> bool:
        """Merge a record; False if it is new and the table is full."""
        h = int.from_bytes(sha[:8], "little")
        mask = len(self.slots) - 1
        i = h & mask
        while (k := self.slots[i]) >= 0:
            e = self.entries[k]
            if e[0] == h and e[1] == content:
                e[2] += n
                if (-chars, doc_id is None, doc_id or 0) < (-e[3], e[4] is None, e[4] or 0):
                    e[3], e[4] = chars, doc_id
                return True
            i = (i + 1) & mask
        if self.entries and self.bytes + len(content) + self.entry_bytes > self.limit:
            return False
        self.slots[i] = len(self.entries)
        self.entries.append([h, content, n, chars, doc_id, sha])
        self.bytes += len(content) + self.entry_bytes
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for k, e in enumerate(self.entries):
                self.slots[self._free(e[0])] = k
        return True


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_RECORD.types)], schema=_RECORD)


def _normalised(batch: pa.RecordBatch) -> tuple[list[bytes], list[int]]:
    texts = pc.fill_null(batch.column("text"), "")
    return [x.translate(None, SPACE_BYTES) for x in texts.cast(pa.binary()).to_pylist()], pc.utf8_length(texts).to_pylist()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each distinct content of a slice of rows."""
    for batch in text_slices(batches, limit=8 << 20):
        table = OpenTable()
        contents, chars = _normalised(batch)
        for content, n, doc_id in zip(contents, chars, batch.column("doc_id").to_pylist()):
            table.add(hashlib.sha256(content).digest(), content, 1, n, doc_id)
        yield _records([(e[5], e[1], e[2], e[3], e[4]) for e in table.entries])


def _probe(limit: int) -> Callable:
    """A bucket's records through a table: resolved groups without content, and what did not fit, with its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable(limit, ENTRY_BYTES)
        for batch in text_slices(batches, "content"):
            over = [r for r in zip(*(c.to_pylist() for c in batch.columns)) if not table.add(*r)]
            if over:
                yield _records(over)
        for i in range(0, len(table.entries), 10_000):
            yield _records([(e[5], None, e[2], e[3], e[4]) for e in table.entries[i : i + 10_000]])

    return run


def duplicate_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(sha, n, chars, doc_id): each distinct content by its digest, its count and the record that stays."""
    fan_out = shuffle_partitions(docs.sparkSession)
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_combine), _RECORD_SQL)
    done = []
    run = Scratch(docs.sparkSession, "op5")
    for level in range(LEVELS):
        bucket = F.xxhash64(F.lit(level), F.col("sha"))
        table = run.write(records.repartition(fan_out, bucket).mapInArrow(lean(_probe(table_bytes)), _RECORD_SQL), f"level{level}")
        done.append(table.filter("content IS NULL").drop("content"))
        records = table.filter("content IS NOT NULL")
        if records.isEmpty():
            break
        fan_out *= 4
    else:
        raise RuntimeError(f"buckets do not fit their tables after {LEVELS} partitionings")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        digests = [hashlib.sha256(x.translate(None, SPACE_BYTES)).digest() for x in pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "sha"])


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs."""
    groups = duplicate_groups(docs, table_bytes).select("sha", F.col("n").alias("group_size"), F.col("doc_id").alias("keep_id"))
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_digests), "doc_id long, sha binary")
    return members.join(groups, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
