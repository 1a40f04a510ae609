"""For every set of words, the first other set whose Jaccard with it exceeds a bound, without a row for each pair.

Words are held as 64-bit hashes; rows with equal sets are one class. The stages:

1. One pass gives each row the id and the hashes of its set, written once (`hashed`).
2. Words are put in one global order, the rare ones first, by counts in cells of a table of fixed size (`ranks`).
3. A pair above the bound shares a word among the first few of both sets (prefix filter: a longer list of the larger set, a
   shorter one of the smaller). A row goes to each bucket that one of these words falls into, with its size and a bitmap of the parities
   of its words: as many bits differ between two bitmaps as words do between the sets, at most. So a bucket rules out
   nearly all of its pairs without their words, and gives the `most` least partners of each set.
4. Only these meet with their words, and only sets of which `most` partners all failed look for further ones, in a next round.

A set asks only for partners that come before its own first row: a row of its own class is above the bound. Nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, put, shared_folder

#: Cells in which words are counted, and how many ranks an octave of counts has.
CELLS, STEPS = 1 << 21, 7
#: Least number of buckets, each a task: smaller ones hold less at once. A set has a row in at most as many as it has first words.
BUCKETS = 64
#: Partners of a set in the first round, and how many times as many in each further one.
MOST, MORE = 8, 8
#: Pairs of a bucket that are looked at together.
CHUNK = 1 << 20
#: Words of a batch that are looked at together.
WORDS = 1 << 20
_FIRST, _NEVER = -(1 << 63), (1 << 63) - 1


def least_common(total: np.ndarray, above: float) -> np.ndarray:
    """Least overlap of two sets whose sizes sum to `total` and whose Jaccard is `above` at least; never too large."""
    return np.ceil(above / (1 + above) * total - 1e-6).astype(np.int64)


def hashed(rows: DataFrame) -> DataFrame:
    """rows (request_id, seq, asks, words) with the id of the set, its size and the hashes of its words instead of words. Null words are an empty set."""
    tokens = F.sort_array(F.array_distinct(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.xxhash64(w))))
    got = rows.select("request_id", F.col("seq").cast("long").alias("seq"), "asks", tokens.alias("tokens"))
    return got.select("request_id", "seq", "asks", F.xxhash64("tokens").alias("sid"), F.size("tokens").alias("k"), "tokens")


def ranks(sets: DataFrame) -> np.ndarray:
    """The rank of each cell: about STEPS times the log of its count. CELLS bytes, whatever the number of words."""
    cell = F.col("token").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")
    counts = sets.select(F.explode("tokens").alias("token")).groupBy(cell).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # One row for each cell at most.
    got = counts.select("cell", F.least(F.lit(255), F.round(STEPS * F.log2("n"))).cast("int").alias("rank")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[got.column("cell").to_numpy()] = got.column("rank").to_numpy()
    return out


def _bits(k: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set: half its words at least, a power of two."""
    return 1 << np.ceil(np.log2(np.maximum(128, k / 2))).astype(np.int64)


def _parities(row: np.ndarray, tokens: np.ndarray, bits: np.ndarray) -> pa.Array:
    """The bitmap of each row: a bit is the parity of the words that fall on it."""
    first = np.concatenate([[0], np.cumsum(bits)])
    at = first[row] + ((tokens >> np.uint64(21)).astype(np.int64) & (bits[row] - 1))
    data = np.packbits(np.bincount(at, minlength=first[-1]).astype(np.uint8) & 1, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer((first // 8).astype(np.int32)), pa.py_buffer(data)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to WORDS words, or one row."""
    for batch in batches:
        total = np.cumsum(batch.column("k").to_numpy().astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + WORDS, "right")))
            yield batch.slice(i, j - i)
            i = j


ENTRIES = "bucket int, sid long, k int, seq long, since long, map binary, keys array<long>, at array<int>"


def _entries(rank: np.ndarray, buckets: int, above: float, met: np.ndarray | None = None) -> Callable:
    """Each set of a batch once for each bucket of the first words of its order: those words (`keys`) and their places (`at`). met: only words of cells where it is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sid, k = batch.column("sid").to_numpy(), batch.column("k").to_numpy().astype(np.int64)
            seq = batch.column("seq").fill_null(_NEVER).to_numpy()
            since = batch.column("since").fill_null(_NEVER).to_numpy()
            # Copies: the least seq stands for all, and whether one of them asks.
            order = np.lexsort((seq, sid))
            new = np.flatnonzero(np.concatenate([[True], sid[order][1:] != sid[order][:-1]]))
            rows, since = order[new], np.minimum.reduceat(since[order], new)
            lists = batch.column("tokens").take(pa.array(rows))
            sid, k, seq = sid[rows], k[rows], seq[rows]
            tokens = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(k)), k)
            maps = _parities(row, tokens, _bits(k))
            key = (rank[(tokens & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
            key = key[np.lexsort((key, row))]
            at = np.arange(len(key)) - np.repeat(np.cumsum(k) - k, k)
            kept = at <= (k - np.ceil(above * k - 1e-6).astype(np.int64))[row]
            if met is not None:
                kept &= met[(key & np.uint64(CELLS - 1)).astype(np.int64)]
            row, key, at = row[kept], key[kept], at[kept]
            bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.lexsort((bucket, row))
            row, key, at, bucket = row[order], key[order], at[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
            mine, ends = row[cuts], pa.array(np.append(cuts, len(row)).astype(np.int32))
            columns = [pa.array(bucket[cuts].astype(np.int32)), pa.array(sid[mine]), pa.array(k[mine].astype(np.int32)), pa.array(seq[mine]), pa.array(since[mine]), maps.take(pa.array(mine))]
            columns += [pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32)))]
            out = pa.RecordBatch.from_arrays(columns, ["bucket", "sid", "k", "seq", "since", "map", "keys", "at"])
            yield from (out.slice(i, 20_000) for i in range(0, out.num_rows, 20_000))

    return run


class _Maps:
    """The bitmaps of a bucket's sets by their width; wider ones are folded for a narrower partner."""

    def __init__(self, maps: list[bytes]):
        self.width = np.array([8 * len(m) for m in maps], np.int64)
        self.row = np.zeros(len(maps), np.int64)
        self.held = {}
        for w in np.unique(self.width).tolist():
            mine = np.flatnonzero(self.width == w)
            self.row[mine] = np.arange(len(mine))
            self.held[w, w] = np.frombuffer(b"".join(maps[i] for i in mine.tolist()), np.uint64).reshape(len(mine), w // 64)

    def folded(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.held:
            x = self.folded(width, 2 * to)
            self.held[width, to] = x[:, : to // 64] ^ x[:, to // 64 :]
        return self.held[width, to]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of sets a[i] and b[i] differ."""
        out = np.zeros(len(a), np.int64)
        kinds = self.width[a] * (1 << 31) + self.width[b]
        for kind in np.unique(kinds).tolist():
            at, (v, w) = np.flatnonzero(kinds == kind), divmod(kind, 1 << 31)
            to = min(v, w)
            out[at] = np.bitwise_count(self.folded(v, to)[self.row[a[at]]] ^ self.folded(w, to)[self.row[b[at]]]).sum(axis=1, dtype=np.int64)
        return out


def _least(late: np.ndarray, early: np.ndarray, seq: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sets, each once, the `most` with the least seq of `early` for each `late`."""
    order = np.lexsort((early, seq[early], late))
    late, early = late[order], early[order]
    new = np.ones(len(late), bool)
    new[1:] = (late[1:] != late[:-1]) | (early[1:] != early[:-1])
    late, early = late[new], early[new]
    start = np.flatnonzero(np.concatenate([[True], late[1:] != late[:-1]])) if len(late) else late
    kept = np.arange(len(late)) - np.repeat(start, np.diff(np.append(start, len(late)))) < most
    return late[kept], early[kept]


def _partners(above: float, most: int) -> Callable:
    """Of the sets of a bucket, (sid, other, seq): the `most` first partners that sizes, places and bitmaps leave to each asking set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        # Rows of one set in one bucket of Spark's may come from several buckets of ours, and from copies.
        sid, of = np.unique(t.column("sid").to_numpy(), return_inverse=True)
        n = len(sid)
        seq, since, k = np.full(n, _NEVER), np.full(n, _NEVER), np.zeros(n, np.int64)
        np.minimum.at(seq, of, t.column("seq").to_numpy())
        np.minimum.at(since, of, t.column("since").to_numpy())
        k[of] = t.column("k").to_numpy()
        one = np.zeros(n, np.int64)
        one[of] = np.arange(len(of))
        maps = _Maps(t.column("map").take(pa.array(one)).to_pylist())
        lists = t.column("keys").combine_chunks()
        size = lists.value_lengths().to_numpy()
        key, at, own = lists.flatten().to_numpy(), t.column("at").combine_chunks().flatten().to_numpy().astype(np.int64), np.repeat(of, size)
        del t, held, lists
        _, key = np.unique(key, return_inverse=True)
        order = np.lexsort((at, own, k[own], key))
        key, at, own = key[order], at[order], own[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        key, at, own = key[new], at[new], own[new]
        # The smaller set of a pair by its short list, the larger by its long one.
        short = np.flatnonzero(at <= k[own] - least_common(2 * k[own], above))
        top = int(k.max()) + 1
        code = key[short] * top + k[own[short]]
        lo = np.searchsorted(code, key * top + np.ceil(above * k[own] - 1e-6).astype(np.int64), "left")
        hi = np.searchsorted(code, key * top + k[own], "right")
        total = np.cumsum(hi - lo)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        i = 0
        while i < len(key):
            # An entry of more than CHUNK partners goes alone.
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CHUNK, "right")))
            c = hi[i:j] - lo[i:j]
            p = np.repeat(np.arange(i, j), c)
            q = short[np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[i:j], c)]
            i = j
            a, b = own[p], own[q]
            need = least_common(k[a] + k[b], above)
            fits = (a != b) & (np.minimum(at[p], at[q]) + np.minimum(k[a] - at[p], k[b] - at[q]) >= need)
            a, b, need = a[fits], b[fits], need[fits]
            # The later of both asks, for what comes after those it has tried.
            x, y = np.where(seq[a] > seq[b], a, b), np.where(seq[a] > seq[b], b, a)
            fits = (seq[y] < seq[x]) & (since[x] <= seq[y])
            x, y, need = x[fits], y[fits], need[fits]
            fits = maps.differ(x, y) <= k[x] + k[y] - 2 * need
            pairs.append((x[fits], y[fits]))
            if sum(len(x) for x, _ in pairs) > CHUNK + 2 * len(pairs[0][0]):
                pairs = [_least(*map(np.concatenate, zip(*pairs)), seq, most)]
        late, early = _least(*map(np.concatenate, zip(*pairs)), seq, most)
        for i in range(0, len(late), 20_000):
            x, y = late[i : i + 20_000], early[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(sid[x]), pa.array(sid[y]), pa.array(seq[y])], ["sid", "other", "seq"])

    return run


def _cells(values: DataFrame, column: str) -> DataFrame:
    """(cell): the cells of a column of 64-bit values, CELLS rows at most."""
    return values.select(F.col(column).bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")).distinct()


def partners(sets: DataFrame, rank: np.ndarray, above: float, most: int, few: bool = False) -> DataFrame:
    """(sid, others): of each asking set that has any, the `most` first possible partners (seq, other), in order. sets: (seq, sid, k, tokens, since), since null where a row does not ask.

    few: only some sets ask, and words that none of them has among its first are not shuffled.
    """
    n = max(BUCKETS, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = sets.filter("k > 0").select("seq", "sid", "k", "tokens", "since")
    met = None
    if few:
        keys = rows.filter("since IS NOT NULL").mapInArrow(_entries(rank, n, above), ENTRIES).select(F.explode("keys").alias("key"))
        met = np.zeros(CELLS, bool)
        met[_cells(keys, "key").toArrow().column("cell").to_numpy()] = True
    entries = rows.mapInArrow(_entries(rank, n, above, met), ENTRIES)
    found = entries.repartition(n, "bucket").mapInArrow(_partners(above, most), "sid long, other long, seq long")
    return found.groupBy("sid").agg(F.slice(F.array_sort(F.collect_set(F.struct("seq", "other"))), 1, most).alias("others"))


def _words(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, tokens) of the sets wanted, each once. Most others go before the shuffle, by the cells of the ids."""
    near = sets.filter("k > 0").select("sid", "tokens", F.col("sid").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")).join(F.broadcast(_cells(wanted, "sid")), "cell", "left_semi")
    return near.select("sid", "tokens").join(wanted.hint("merge"), "sid", "left_semi").dropDuplicates(["sid"])


def _tried(found: DataFrame, words: DataFrame, above: float) -> DataFrame:
    """(sid, first, last, n): the seq of the first of a set's partners above the bound, null if none is, that of the last one, and their number. words: (sid, tokens), each set once."""
    pairs = found.select("sid", F.explode("others").alias("o")).select("sid", "o.seq", "o.other")
    both = pairs.join(words.withColumnsRenamed({"sid": "other", "tokens": "_b"}), "other").join(words.withColumnRenamed("tokens", "_a"), "sid")
    i = F.size(F.array_intersect("_a", "_b"))
    hit = i / (F.size("_a") + F.size("_b") - i) > above
    return both.select("sid", "seq", hit.alias("hit")).groupBy("sid").agg(F.min(F.when(F.col("hit"), F.col("seq"))).alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))


def first_above(rows: DataFrame, above: float, most: int = MOST) -> DataFrame:
    """(request_id, offender) of the rows that ask: the least seq of all rows whose set has a Jaccard above the bound with their own; null if none has.

    rows: (request_id, seq, asks, words[]); a row without seq is nobody's offender, an empty set has none. Rows of one request_id share the least.
    """
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "wordsets")
    sets = put(hashed(rows), f"{path}/sets")
    rank, answers = ranks(sets), []
    asking = sets.withColumn("since", F.when(F.col("asks"), F.lit(_FIRST)))
    while True:
        at = f"{path}/{len(answers)}"
        found = put(partners(asking, rank, above, most, few=bool(answers)), f"{at}/found")
        wanted = found.select("sid").union(found.select(F.explode("others.other"))).distinct()
        words = put(_words(sets, wanted), f"{at}/words")
        answers.append(put(_tried(found, words, above), f"{at}/tried"))
        drop(spark, f"{at}/words")
        drop(spark, f"{at}/found")
        # Where fewer than `most` were found there are no others.
        left = answers[-1].filter((F.col("first").isNull()) & (F.col("n") == most)).select("sid", (F.col("last") + 1).alias("since"))
        if left.isEmpty():
            break
        asking, most = sets.join(left, "sid", "left"), most * MORE
    first = reduce(DataFrame.union, answers).filter("first IS NOT NULL").select("sid", "first")
    own = sets.filter("k > 0 AND seq IS NOT NULL").groupBy("sid").agg(F.min("seq").alias("own"))
    out = sets.filter("asks").select("request_id", "sid").join(own, "sid", "left").join(first, "sid", "left")
    least = F.min(F.coalesce("first", "own")).over(Window.partitionBy("request_id"))
    return out.select("request_id", F.when(F.col("request_id").isNotNull(), least).alias("offender"))
