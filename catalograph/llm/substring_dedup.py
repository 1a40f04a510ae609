"""Substring dedup by relative Lempel-Ziv parsing.

Every document is a reference for the documents with larger ids. The index of the reference maps seeds, windows of `WINDOW`
words, to their first place, (document, position). It is cut into blocks by the anchor of a window (the least hash of its
5-grams, so that equal windows lie in the same block).

1. One pass gives each text its anchors. Anchors that only one text has are left out by a first exchange of packed
   hashes: no window with such an anchor can stand in two texts. Texts with equal words are parsed once; a copy is one
   factor, the whole of the text with the smallest id.
2. The texts that keep anchors look their windows up in every block that may hold one.
3. Each document is factored greedily: from the first word behind the last factor on, the next window that the index has
   starts a factor, which goes on as long as the reference does; else one word is passed over. A factor of n windows covers
   n + WINDOW - 1 words; factors are disjoint and in order. The windows that straddle the end of a factor are checked
   against the index, too. Factors and straddling windows found are the duplicate spans; nothing else is removed.

The index holds a window by its first place only, so a factor is as long as that place goes on; another document may go on
longer, which moves the cut between factors but no duplicate span.

Every slice of a task keeps only the first place of a window for the block and resolves the later ones itself, so a passage
that a third of all documents hold reaches its block once per slice. Hashes of windows are 96 bits.

Texts are shuffled twice: those with shared anchors to meet them, and all to meet their spans. Intermediate tables are deleted as
soon as the next one is written.

Defined cases: null, empty and shorter texts have no windows and keep all words; repeats inside one document stay unless
a smaller document has them; rows that share a doc_id are judged each by its own text, against smaller doc_ids alone; a null
doc_id counts as larger than all, and rows with null doc_ids don't count against each other; other columns are not read. Kept
words are joined by one space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .wordgrams import U, Words, grams, lean, mix, pack, runs_by_key, sliding_min, text_slices, unpack

WINDOW, GRAM = 13, 5
#: Stands for a null doc_id in comparisons.
LAST = (1 << 63) - 1
_FLUSH = 1_500_000


def window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash, second hash) of every run of `window` word hashes."""
    return sliding_min(grams(h, GRAM), window - GRAM + 1), grams(h, window, seed=2), (grams(h, window, seed=3) >> U(32)).astype(np.uint32)


def text_id(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _nulls(n: int, schema: pa.Schema, given: dict) -> pa.RecordBatch:
    have = {k: v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in given.items()}
    return pa.RecordBatch.from_arrays([have[f.name] if f.name in have else pa.nulls(n, f.type) for f in schema], schema=schema)


_FIRST = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("bucket", pa.int32()), ("anchors", pa.binary()), ("sids", pa.binary()), ("at", pa.binary()), ("shared", pa.int64())])
_FIRST_SQL = "kind int, doc_id long, crc long, n long, sid long, bucket int, anchors binary, sids binary, at binary, shared long"
ROWS, ANCHORS, SHARED = 0, 1, 2


def _first_pass(buckets: int, window: int) -> Callable:
    """Rows of three kinds: a row of docs with words (doc_id, crc, n, sid), packed (anchor, sid) entries for a bucket, and anchors (sid, shared) that are known to be shared."""

    def flush(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        sids = np.array(sorted(held), np.int64)
        anchors = np.concatenate([held[s] for s in sids.tolist()])
        at = np.repeat(np.arange(len(sids), dtype=np.uint32), [len(held[s]) for s in sids.tolist()])
        order = np.argsort(anchors, kind="stable")
        anchors, at = anchors[order], at[order]
        later = np.zeros(len(anchors), bool)  # third or later text with the same anchor
        later[2:] = anchors[2:] == anchors[:-2]
        if later.any():
            yield _nulls(int(later.sum()), _FIRST, {"kind": [SHARED] * int(later.sum()), "sid": sids[at[later]], "shared": anchors[later].view(np.int64)})
        anchors, at = anchors[~later], at[~later]
        to = (mix(anchors) % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        anchors, at, to = anchors[order], at[order], to[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        rows = []
        for k in range(buckets):
            if (a := cuts[k]) < (b := cuts[k + 1]):
                mine, where = np.unique(at[a:b], return_inverse=True)
                rows.append((k, pack(anchors[a:b], True), pack(sids[mine], True), pack(where.astype(np.uint32))))
        c = list(zip(*rows))
        yield _nulls(len(rows), _FIRST, {"kind": [ANCHORS] * len(rows), "bucket": c[0], "anchors": c[1], "sids": c[2], "at": c[3]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        weight = 0
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            h = words.hashes()
            least = sliding_min(grams(h, GRAM), window - GRAM + 1)
            ns, ids = [], []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                sid = text_id(h[a:b])
                ns.append(b - a)
                ids.append(sid)
                if b - a >= window and sid not in held:
                    held[sid] = np.unique(least[a : b - window + 1])
                    weight += len(held[sid])
            yield _nulls(batch.num_rows, _FIRST, {"kind": [ROWS] * batch.num_rows, "doc_id": batch.column("doc_id"), "crc": batch.column("crc"), "n": ns, "sid": ids})
            if weight > _FLUSH:
                yield from flush(held)
                held, weight = {}, 0
        yield from flush(held)

    return run


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, shared) of anchors that two texts of the bucket have."""
    for rows in runs_by_key(batches, "bucket"):
        anchor, sid = [], []
        for anchors, sids, at in zip(*(rows.column(c).to_pylist() for c in ("anchors", "sids", "at"))):
            anchor.append(unpack(anchors, np.uint64, True))
            sid.append(unpack(sids, np.int64, True)[unpack(at, np.uint32)])
        anchor, sid = np.concatenate(anchor), np.concatenate(sid)
        order = np.lexsort((sid, anchor))
        anchor, sid = anchor[order], sid[order]
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        ends = np.append(starts[1:], len(anchor))
        many = np.repeat(sid[starts] != sid[ends - 1], ends - starts)
        yield pa.RecordBatch.from_arrays([pa.array(sid[many]), pa.array(anchor[many].view(np.int64))], ["sid", "shared"])


_SECOND = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("seconds", pa.binary()), ("sids", pa.binary()), ("docs", pa.binary()), ("at", pa.binary()), ("pos", pa.binary()), ("sid", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32())])
_SECOND_SQL = "bucket int, hashes binary, seconds binary, sids binary, docs binary, at binary, pos binary, sid long, start int, len int, ref long, ref_start int"
_PIECE = pa.schema([("sid", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32())])
_PIECE_SQL = "sid long, start int, len int, ref long, ref_start int"


def pieces(sid: np.ndarray, pos: np.ndarray, ref: np.ndarray, ref_pos: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of consecutive windows of a text whose places in the reference are consecutive too."""
    order = np.lexsort((pos, sid))
    sid, pos, ref, ref_pos = sid[order], pos[order], ref[order], ref_pos[order]
    new = np.ones(len(sid), bool)
    new[1:] = (sid[1:] != sid[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (ref_pos[1:] != ref_pos[:-1] + 1)
    at = np.flatnonzero(new)
    return {"sid": sid[at], "start": pos[at].astype(np.int32), "len": np.diff(np.append(at, len(sid))).astype(np.int32), "ref": ref[at], "ref_start": ref_pos[at].astype(np.int32)}


def _first_places(w: np.ndarray, second: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the windows sorted by content, document, position; for each in that order the index of the first one with its content."""
    order = np.lexsort((pos, doc, second, w))
    w, second = w[order], second[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (second[1:] != second[:-1])
    return order, np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))


def _second_pass(buckets: int, window: int) -> Callable:
    """Look windows up within the slice, and send first places to their blocks. Rows: packed windows for a bucket, pieces."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        m, w, second, pos = (np.concatenate([x[i] for x in held]) for i in range(2, 6))
        nth = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        sids, docs = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        order, first = _first_places(w, second, docs[nth], pos)
        m, w, second, pos, nth = m[order], w[order], second[order], pos[order], nth[order]
        hit = docs[nth] > docs[nth[first]]
        if hit.any():
            found = pieces(sids[nth[hit]], pos[hit], docs[nth[first]][hit], pos[first][hit])
            yield _nulls(len(found["start"]), _SECOND, found)
        m, w, second, pos, nth = (x[~hit] for x in (m, w, second, pos, nth))
        to = (mix(m) % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, w, second, pos, nth = to[order], w[order], second[order], pos[order], nth[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        rows = []
        for k in range(buckets):
            if (a := cuts[k]) < (b := cuts[k + 1]):
                mine, where = np.unique(nth[a:b], return_inverse=True)
                rows.append((k, pack(w[a:b], True), pack(second[a:b]), pack(sids[mine]), pack(docs[mine]), pack(where.astype(np.uint32)), pack(pos[a:b].astype(np.uint32))))
        if rows:
            yield _nulls(len(rows), _SECOND, dict(zip(("bucket", "hashes", "seconds", "sids", "docs", "at", "pos"), zip(*rows))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            m, w, second = window_hashes(words.hashes(), window)
            for i, (doc, sid, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "sid", "known")))):
                a, b = int(words.first[i]), int(words.first[i + 1])
                own = m[a : b - window + 1]
                keep = np.flatnonzero(np.isin(own, np.array(known, np.int64).view(np.uint64)))
                held.append((sid, doc, own[keep], w[a + keep], second[a + keep], keep))
                weight += len(keep)
            if weight > _FLUSH // 2:
                yield from flush(held)
                held, weight = [], 0
        yield from flush(held)

    return run


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: index its windows by first place, and look all windows in it up."""
    for rows in runs_by_key(batches, "bucket"):
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        for hashes, seconds, sids, docs, at, pos in zip(*(rows.column(c).to_pylist() for c in ("hashes", "seconds", "sids", "docs", "at", "pos"))):
            where = unpack(at, np.uint32)
            for to, x in zip(got, (unpack(hashes, np.uint64, True), unpack(seconds, np.uint32), unpack(sids, np.int64)[where], unpack(docs, np.int64)[where], unpack(pos, np.uint32).astype(np.int64))):
                to.append(x)
        w, second, sid, doc, pos = (np.concatenate(x) for x in got)
        order, first = _first_places(w, second, doc, pos)
        sid, doc, pos = sid[order], doc[order], pos[order]
        hit = doc > doc[first]
        if hit.any():
            found = pieces(sid[hit], pos[hit], doc[first][hit], pos[first][hit])
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in _PIECE], schema=_PIECE)


Span = tuple[int, int, int, int]


def factorize(found: list[Span], window: int = WINDOW) -> tuple[list[Span], list[Span]]:
    """(factors, straddling), both (start, words, ref, ref_start), from the pieces (start, windows, ref, ref_start) that the index has of a document.

    Factors are the greedy parse from left to right. Straddling are the windows that begin inside a factor and end behind it.
    """
    runs: list[Span] = []
    for start, n, ref, at in sorted(found):
        if runs and (over := runs[-1][0] + runs[-1][1] - start) > 0:  # looked up more than once
            start, n, at = start + over, n - over, at + over
            if n <= 0:
                continue
        if runs and runs[-1][0] + runs[-1][1] == start and runs[-1][2] == ref and runs[-1][3] + runs[-1][1] == at:
            runs[-1] = (runs[-1][0], runs[-1][1] + n, ref, runs[-1][3])
        else:
            runs.append((start, n, ref, at))
    factors: list[Span] = []
    straddling: list[Span] = []
    end = 0
    for start, n, ref, at in runs:
        last = start + n - 1
        if start < end:
            straddling.append((start, min(last, end - 1) - start + window, ref, at))
        if last >= end:
            begin = max(start, end)
            factors.append((begin, last - begin + window, ref, at + begin - start))
            end = last + window
    return factors, straddling


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("factors", _SPANS), ("straddling", _SPANS)])
_SPANS_SQL = "array<struct<start:int,words:int,ref_doc:long,ref_start:int>>"
_CUT_SQL = f"doc_id long, n_words long, n_removed long, kept string, factors {_SPANS_SQL}, straddling {_SPANS_SQL}"


def _cut(window: int) -> Callable:
    """Factor every text and take the duplicate spans out of it."""

    def spans(found: list[Span]) -> list[dict]:
        return [{"start": s, "words": n, "ref_doc": r, "ref_start": p} for s, n, r, p in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for text, whole, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("whole").to_pylist(), batch.column("found").to_pylist()):
                words = (text or b"").split()
                factors, straddling = ([(0, len(words), whole, 0)], []) if whole is not None else factorize([(x["start"], x["len"], x["ref"], x["ref_start"]) for x in found or ()], window)
                if factors:
                    gone = np.zeros(len(words), bool)
                    for start, n, _, _ in factors + straddling:
                        gone[start : start + n] = True
                    left = [words[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    left = words
                rows.append((len(words), len(words) - len(left), b" ".join(left), spans(factors), spans(straddling)))
            n, removed, kept, factors, straddling = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, _SPANS), pa.array(straddling, _SPANS)], schema=_CUT)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors, straddling) of every row of docs.

    kept is the text that is left; factors and straddling are the spans of words that were taken out, with their place in the reference. A
    copy of a whole text is one factor.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = max(64, 2 * parts)
    run = Scratch(spark, "op6")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("crc"), "text")
    first = run.write(docs.mapInArrow(lean(_first_pass(buckets, window)), _FIRST_SQL), "anchors")
    named = first.filter(f"kind = {ROWS} AND n >= {window}").groupBy("sid", "doc_id", "crc").agg(F.lit(1)).select("sid", "doc_id", "crc")
    classes = named.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc")).alias("least")).select("sid", F.col("least.doc_id").alias("rep"), F.col("least.crc").alias("rep_crc"))
    by_bucket = first.filter(f"kind = {ANCHORS}").select("bucket", "anchors", "sids", "at").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    shared = first.filter(f"kind = {SHARED}").select("sid", "shared").unionByName(by_bucket.mapInArrow(lean(_shared_anchors), "sid long, shared long"))
    wanted = shared.groupBy("sid").agg(F.collect_set("shared").alias("known")).join(classes, "sid")
    asked = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("crc") == F.col("rep_crc"))).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "sid", "known", "text")
    second = run.write(asked.mapInArrow(lean(_second_pass(buckets, window)), _SECOND_SQL), "windows")
    blocks = second.filter("bucket IS NOT NULL").select("bucket", "hashes", "seconds", "sids", "docs", "at", "pos").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = second.filter("start IS NOT NULL").select("sid", "start", "len", "ref", "ref_start").unionByName(blocks.mapInArrow(lean(_look_up), _PIECE_SQL))
    found = found.groupBy("sid").agg(F.collect_list(F.struct("start", "len", "ref", "ref_start")).alias("found"))
    # The rows that lose words: copies of a text with a smaller id lose all of them.
    whole = F.when(F.col("rep") < F.coalesce("doc_id", F.lit(LAST)), F.col("rep"))
    marked = named.join(classes.select("sid", "rep"), "sid").join(found, "sid", "left").select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), whole.alias("whole"), F.when(whole.isNull(), F.col("found")).alias("found"))
    marked = run.write(marked.filter("whole IS NOT NULL OR found IS NOT NULL"), "spans")
    run.delete("anchors", "windows")
    out = docs.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc")), "left").select("doc_id", "text", "whole", "found")
    return out.mapInArrow(lean(_cut(window)), _CUT_SQL)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the substring dedup of all documents."""
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: {'st': i, 'c': array_to_string(ws[i:i + 12], ' ')})) AS u FROM w WHERE len(ws) >= 13),
f AS (SELECT u.c AS c, min(doc_id) AS d FROM s GROUP BY 1),
g AS (SELECT DISTINCT s.doc_id, unnest(range(s.u.st, s.u.st + 13)) AS p FROM s JOIN f ON s.u.c = f.c WHERE f.d < s.doc_id),
h AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN h ON h.doc_id = w.doc_id
"""
