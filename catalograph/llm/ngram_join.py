"""Similarity join on sets of word n-grams by signature trees, exact for Jaccard >= `percent` / 100.

A document's set is its distinct 5-word shingles (A-Z lower-cased), held as 64-bit hashes. The stages:

1. One pass over the texts gives each distinct set an id, a size, a bitmap of its tokens, and its prefix: the first
   |x| - ceil(s|x|) + 1 tokens in one global order, of which two sets that link share one at least. The order puts
   tokens that are very frequent in the corpus (by a counting sketch of fixed size) last, so that passages which many
   documents share are seldom in a prefix.
2. Sets that share a prefix token meet in a group; groups with the same members are one group.
3. In every group a signature tree is built: nodes hold the OR of the bitmaps below them and the range of sizes. The
   dual traversal drops pairs of nodes whose sizes cannot fit or whose most possible overlap is too small. Pairs of
   leaves that survive become candidate edges, but only as a spanning forest: a pair already connected is not emitted.
4. The components of the candidate edges are clusters. The full sets of a cluster meet in blocks (bounded in
   documents; pairs of blocks for large clusters, dropped if their sizes cannot fit), and the same dual traversal runs
   again, now ending in exact intersections. Its spanning forests give the components of the links.

No step emits all pairs of a group, and none is sampled or capped: larger groups become more blocks. The blocks of a cluster
are cut by counts of (cluster, size), so no cluster is ever sorted in one task.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; fewer than five words are one
shingle, the whole sequence; equal sets are one class whatever their number; rows that share a doc_id are separate
texts with the same name, null doc_ids too (rows are told apart by doc_id and a hash of the text); a null doc_id counts as larger
than any other; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .components import connected_components
from .wordgrams import U, Words, grams, lean, mix, pack, runs_by_key, text_slices, unpack

WIDTH, PERCENT = 5, 80
SKETCH_BITS = 22
#: Sets in one block of a group and of a cluster.
GROUP_BLOCK, CLUSTER_BLOCK = 2048, 512
LEAF, FANOUT = 16, 4
ROWS, ENTRIES = 0, 1
#: Prefix tokens that a task holds before it packs them.
FLUSH = 500_000


def needed(total: int, percent: int = PERCENT) -> int:
    """Least overlap of two sets whose sizes sum to `total` and whose Jaccard is `percent` at least."""
    return -(-percent * total // (100 + percent))


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words = Words(column, lower=True)
    h = words.hashes()
    g = grams(h, width)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            yield np.unique(g[a : b - width + 1])
        elif b > a:
            yield grams(h[a:b], b - a, seed=1)
        else:
            yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def bitmap(tokens: np.ndarray) -> bytes:
    """One and a half to three bits a token, a power of two: folding in halves compares maps of different sizes."""
    bits = 1 << max(6, (3 * len(tokens) // 2).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(tokens & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(bits: int, size: int, to: int) -> int:
    """A bitmap of `size` bits folded to `to` bits."""
    while size > to:
        size >>= 1
        bits = (bits >> size) | (bits & ((1 << size) - 1))
    return bits


class _Node:
    __slots__ = ("lo", "hi", "least", "most", "bits", "size", "kids", "lost")

    def __init__(self, lo: int, hi: int, least: int, most: int, bits: int, size: int, kids: list):
        self.lo, self.hi, self.least, self.most, self.bits, self.size, self.kids = lo, hi, least, most, bits, size, kids
        self.lost: dict[int, int] = {}


class SignatureTree:
    """Sets sorted by size; leaves of LEAF neighbours under nodes of FANOUT, each with its OR-combined bitmap and range of sizes."""

    def __init__(self, sizes: list[int], maps: list[bytes], percent: int = PERCENT):
        self.order = sorted(range(len(sizes)), key=lambda i: (sizes[i], maps[i]))
        self.n = [sizes[i] for i in self.order]
        self.bits = [int.from_bytes(maps[i], "little") for i in self.order]
        self.size = [8 * len(maps[i]) for i in self.order]
        self.percent = percent
        level = [self._node(i, min(i + LEAF, len(self.n)), []) for i in range(0, len(self.n), LEAF)]
        while len(level) > 1:
            level = [self._node(k[0].lo, k[-1].hi, k) for k in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))]
        self.root = level[0] if level else None

    def _node(self, lo: int, hi: int, kids: list) -> _Node:
        size = min(k.size for k in kids) if kids else min(self.size[lo:hi])
        bits = 0
        for x, s in ((k.bits, k.size) for k in kids) if kids else zip(self.bits[lo:hi], self.size[lo:hi]):
            bits |= fold(x, s, size)
        return _Node(lo, hi, self.n[lo], self.n[hi - 1], bits, size, kids)

    def _sizes_fit(self, least_a: int, most_a: int, least_b: int, most_b: int) -> bool:
        return 100 * most_a >= self.percent * least_b and 100 * most_b >= self.percent * least_a

    def _may_link(self, i: int, j: int) -> bool:
        """Bound for two sets: common bits, and the tokens that shared a bit with another token of their own set."""
        a, b, size = self.bits[i], self.bits[j], min(self.size[i], self.size[j])
        a, b = fold(a, self.size[i], size), fold(b, self.size[j], size)
        most = (a & b).bit_count() + min(self.n[i] - a.bit_count(), self.n[j] - b.bit_count())
        return most >= needed(self.n[i] + self.n[j], self.percent)

    def _may_hold(self, p: _Node, q: _Node) -> bool:
        if not self._sizes_fit(p.least, p.most, q.least, q.most):
            return False
        if p is q:
            return True
        size = min(p.size, q.size)
        common = (fold(p.bits, p.size, size) & fold(q.bits, q.size, size)).bit_count()
        return common + min(self._lost(p, size), self._lost(q, size)) >= needed(p.least + q.least, self.percent)

    def _lost(self, p: _Node, size: int) -> int:
        """Most tokens that a set below p loses to shared bits in a map of `size` bits."""
        if size not in p.lost:
            p.lost[size] = max(n - fold(b, s, size).bit_count() for n, b, s in zip(self.n[p.lo : p.hi], self.bits[p.lo : p.hi], self.size[p.lo : p.hi]))
        return p.lost[size]

    def forest(self, links: Callable[[int, int], bool] | None = None, parts: list[int] | None = None) -> list[tuple[int, int]]:
        """Edges that connect all pairs that may link (and do, by `links`); indices are those of the caller. parts: only pairs of different parts count, if there are two."""
        parent = list(range(len(self.n)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        side = [parts[i] for i in self.order] if parts and len(set(parts)) > 1 else None
        out: list[tuple[int, int]] = []
        stack = [(self.root, self.root)] if self.root else []
        while stack:
            p, q = stack.pop()
            if not self._may_hold(p, q):
                continue
            if p.kids or q.kids:
                if p is q:
                    stack += [(x, y) for i, x in enumerate(p.kids) for y in p.kids[i:]]
                elif p.kids and (not q.kids or p.hi - p.lo >= q.hi - q.lo):
                    stack += [(x, q) for x in p.kids]
                else:
                    stack += [(p, x) for x in q.kids]
                continue
            for i in range(p.lo, p.hi):
                ni, root = self.n[i], find(i)
                for j in range(max(q.lo, i + 1) if p is q else q.lo, q.hi):
                    nj = self.n[j]
                    if 100 * min(ni, nj) < self.percent * max(ni, nj) or (side and side[i] == side[j]):
                        continue
                    other = find(j)
                    if other != root and self._may_link(i, j) and (links is None or links(self.order[i], self.order[j])):
                        parent[other] = root
                        out.append((self.order[i], self.order[j]))
        return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens by hash, as 16 slices of a table of fixed size."""
    total = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in text_slices(batches):
        for tokens in shingle_sets(batch.column("text")):
            np.add.at(total, (tokens & U((1 << SKETCH_BITS) - 1)).astype(np.int64), np.uint32(1))
    if total.any():
        slices = total.reshape(16, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([pack(x) for x in slices], pa.binary())], ["slice", "counts"])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in runs_by_key(batches, "slice"):
        total = sum(unpack(x, np.uint32).astype(np.int64) for x in rows.column("counts").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([rows.column("slice")[0].as_py()], pa.int32()), pa.array([pack(total)], pa.binary())], ["slice", "counts"])


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """For each cell of the sketch: 0 if its count is ordinary, else the rounded log of how far it is above. 2**SKETCH_BITS bytes, whatever the corpus."""
    parts = docs.select("text").mapInArrow(lean(_sketch), "slice int, counts binary").repartition(16, "slice").sortWithinPartitions("slice").mapInArrow(lean(_sum_slices), "slice int, counts binary").collect()
    counts = np.zeros((16, (1 << SKETCH_BITS) // 16), np.int64)
    for row in parts:
        counts[row["slice"]] = unpack(bytes(row["counts"]), np.int64)
    usual = 3 * counts.mean() + 3
    return np.maximum(0, np.ceil(np.log2(np.maximum(counts.reshape(-1), 1) / usual))).astype(np.uint8)


def _prefixes(levels: np.ndarray, buckets: int, percent: int) -> Callable:
    """Rows of two kinds: one per document (doc_id, crc, n, sid, map), and per bucket and some texts the packed (token, set) entries of prefixes."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("map", pa.binary()), ("bucket", pa.int32()), ("entries", pa.binary()), ("sids", pa.binary()), ("at", pa.binary()), ("sizes", pa.binary())])

    def flush(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sids = np.array(sorted(held), np.int64)
        if not len(sids):
            return
        sizes = np.array([held[s][1] for s in sids.tolist()], np.uint32)
        tokens = np.concatenate([held[s][0] for s in sids.tolist()])
        at = np.repeat(np.arange(len(sids), dtype=np.uint32), [len(held[s][0]) for s in sids.tolist()])
        to = (mix(tokens) % U(buckets)).astype(np.int64)
        order = np.lexsort((tokens, to))
        tokens, at, to = tokens[order], at[order], to[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        rows = []
        for k in range(buckets):
            if (a := cuts[k]) < (b := cuts[k + 1]):
                mine, where = np.unique(at[a:b], return_inverse=True)
                rows.append((k, pack(tokens[a:b], True), pack(sids[mine], True), pack(where.astype(np.uint32)), pack(sizes[mine])))
        k = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([ENTRIES] * k, pa.int32())] + [pa.nulls(k, schema.field(i).type) for i in range(1, 6)] + [pa.array(list(c), schema.field(i + 6).type) for i, c in enumerate(zip(*rows))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        weight = 0
        for batch in text_slices(batches):
            ns, ids, maps = [], [], []
            for tokens in shingle_sets(batch.column("text")):
                n = len(tokens)
                sid = set_id(tokens) if n else None
                ns.append(n)
                ids.append(sid)
                maps.append(bitmap(tokens) if n and sid not in held else None)
                if n and sid not in held:
                    take = n - needed_in(n, percent) + 1
                    level = levels[(tokens & U(len(levels) - 1)).astype(np.int64)]
                    held[sid] = (tokens[np.argsort(level, kind="stable")[:take]] if level.any() else tokens[:take], n)
                    weight += take
            docs = [pa.array([ROWS] * batch.num_rows, pa.int32()), batch.column("doc_id").cast(pa.int64()), batch.column("crc"), pa.array(ns, pa.int32()), pa.array(ids, pa.int64()), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(docs + [pa.nulls(batch.num_rows, schema.field(i).type) for i in range(6, 11)], schema=schema)
            if weight > FLUSH:
                yield from flush(held)
                held, weight = {}, 0
        yield from flush(held)

    return run


def needed_in(n: int, percent: int) -> int:
    """Least overlap with any set that a set of n may link with."""
    return math.ceil(percent * n / 100)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _groups(percent: int) -> Callable:
    """For each bucket: sets that share a token, as rows (grp, part, sid); groups with the same members once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_by_key(batches, "bucket"):
            token, sid, n = [], [], []
            for entries, sids, at, sizes in zip(*(rows.column(c).to_pylist() for c in ("entries", "sids", "at", "sizes"))):
                where = unpack(at, np.uint32)
                token.append(unpack(entries, np.uint64, True))
                sid.append(unpack(sids, np.int64, True)[where])
                n.append(unpack(sizes, np.uint32)[where])
            token, sid, n = np.concatenate(token), np.concatenate(sid), np.concatenate(n)
            order = np.lexsort((sid, token))
            token, sid, n = token[order], sid[order], n[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
            token, sid, n = token[new], sid[new], n[new]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            counts = np.diff(np.append(starts, len(token)))
            name = np.add.reduceat(mix(sid.view(np.uint64)), starts) ^ mix(counts.astype(np.uint64))
            _, once = np.unique(np.where(counts > 1, name, U(0)), return_index=True)
            once = once[counts[once] > 1]
            small, large = once[counts[once] <= GROUP_BLOCK], once[counts[once] > GROUP_BLOCK]
            c = counts[small]
            at = np.repeat(starts[small] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum()) if len(small) else np.zeros(0, np.int64)
            out = [(_signed(np.repeat(name[small], c)), np.zeros(len(at), np.int32), sid[at])]
            for k in large.tolist():
                a, b = starts[k], starts[k] + counts[k]
                by_size = a + np.argsort(n[a:b], kind="stable")
                blocks = [by_size[i : i + GROUP_BLOCK] for i in range(0, len(by_size), GROUP_BLOCK)]
                for i, x in enumerate(blocks):
                    for j, y in enumerate(blocks[i:], i):
                        if 100 * int(n[x[-1]]) >= percent * int(n[y[0]]):
                            key = mix(np.array([int(name[k]) ^ (i << 20) ^ (j << 42)], np.uint64))
                            both = [(x, 0)] if i == j else [(x, 0), (y, 1)]
                            out += [(_signed(np.repeat(key, len(z))), np.full(len(z), p, np.int32), sid[z]) for z, p in both]
            for g, p, s in out:
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(p), pa.array(s)], ["grp", "part", "sid"])

    return run


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=_EDGES)


def _candidates(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for rows in runs_by_key(batches, "grp"):
            sid, part, n, maps = (rows.column(c).to_pylist() for c in ("sid", "part", "n", "map"))
            edges += [(sid[i], sid[j]) for i, j in SignatureTree(n, maps, percent).forest(parts=part)]
            if len(edges) > 50_000:
                yield _edge_batch(edges)
                edges = []
        yield _edge_batch(edges)

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, tokens) of texts, each set once."""
    seen: set[int] = set()
    for batch in text_slices(batches):
        out = []
        for sid, tokens in zip(batch.column("sid").to_pylist(), shingle_sets(batch.column("text"))):
            if sid not in seen:
                seen.add(sid)
                out.append((sid, tokens.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["sid", "tokens"])


def _links(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for rows in runs_by_key(batches, "block"):
            sid, part = rows.column("sid").to_pylist(), rows.column("part").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]

            def linked(i: int, j: int) -> bool:
                return len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= needed(len(sets[i]) + len(sets[j]), percent)

            edges += [(sid[i], sid[j]) for i, j in SignatureTree([len(s) for s in sets], [bitmap(s) for s in sets], percent).forest(linked, part)]
            if len(edges) > 50_000:
                yield _edge_batch(edges)
                edges = []
        yield _edge_batch(edges)

    return run


def _blocks(member: DataFrame) -> DataFrame:
    """member (sid, root, n, ...) with blk: a number of its block in the cluster, of about CLUSTER_BLOCK sets of like sizes.

    Sets are placed by the running count over the sizes of a cluster; a size that fills more than a block is dealt by a hash of sid.
    """
    sizes = member.groupBy("root", "n").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("base", F.floor(before / CLUSTER_BLOCK) * (1 << 24))
    own = F.when(F.col("c") > CLUSTER_BLOCK, 1 + F.pmod(F.xxhash64("sid"), F.ceil(F.col("c") / CLUSTER_BLOCK))).otherwise(0)
    return member.join(sizes, ["root", "n"]).withColumn("blk", F.col("base") + own).drop("c", "base")


def _components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, crc, n, sid), crc the hash of the text, sid null for an empty set; and (sid, root, doc_id): the root and least doc_id of every set."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = max(64, 2 * parts)
    run = Scratch(spark, "op8")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("crc"), "text")
    schema = "kind int, doc_id long, crc long, n int, sid long, map binary, bucket int, entries binary, sids binary, at binary, sizes binary"
    passed = run.write(docs.mapInArrow(lean(_prefixes(frequency_levels(docs), buckets, percent)), schema), "prefixes")
    named = passed.filter(f"kind = {ROWS}").select("doc_id", "crc", "n", "sid", "map")

    groups = passed.filter(f"kind = {ENTRIES}").select("bucket", "entries", "sids", "at", "sizes").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_groups(percent)), "grp long, part int, sid long").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc")).alias("least")
    classes = named.filter("sid IS NOT NULL").groupBy("sid").agg(F.first("n").alias("n"), F.max("map").alias("map"), least).select("sid", "n", "map", "least.doc_id", "least.crc")
    met = groups.join(classes.select("sid", "n", "map"), "sid").select("grp", "part", "sid", "n", "map").repartition(parts, "grp").sortWithinPartitions("grp")
    clusters = connected_components(met.mapInArrow(lean(_candidates(percent)), "u long, v long"), "op8-candidates")
    member = run.write(_blocks(clusters.join(classes, clusters.node == F.col("sid")).select("sid", "root", "n", "doc_id", "crc")), "members")

    stat = member.groupBy("root", "blk").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = stat.alias("a"), stat.alias("b")
    fits = (100 * F.col("a.most") >= percent * F.col("b.least")) & (100 * F.col("b.most") >= percent * F.col("a.least"))
    pairs = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.blk") <= F.col("b.blk")) & fits)
    pairs = pairs.select(F.col("a.root").alias("root"), F.xxhash64("a.root", "a.blk", "b.blk").alias("block"), F.explode(F.array_distinct(F.array(F.struct(F.col("a.blk").alias("blk"), F.lit(0).alias("part")), F.struct(F.col("b.blk").alias("blk"), F.when(F.col("a.blk") == F.col("b.blk"), 0).otherwise(1).alias("part"))))).alias("x")).select("root", "block", "x.blk", "x.part")
    wanted = member.select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), "sid")
    # A sort-merge join at every size: the sets asked for grow with the documents.
    sets = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("crc") == F.col("_crc"))).select("sid", "text").mapInArrow(lean(_full_sets), "sid long, tokens binary")
    blocks = member.join(pairs, ["root", "blk"]).select("sid", "block", "part").join(sets, "sid").select("block", "part", "sid", "tokens").repartition(parts, "block").sortWithinPartitions("block")
    linked = connected_components(blocks.mapInArrow(lean(_links(percent)), "u long, v long"), "op8-links")

    return named, classes.select("sid", "doc_id").join(linked, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("root"), "doc_id")


def similarity_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; component_id is the least doc_id reachable by links."""
    named, label = _components(docs, percent)
    least = label.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "root").select(F.col("sid").alias("_sid"), "component_id")
    return named.join(label, F.col("sid") == F.col("_sid"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def component_texts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, crc, n_rows, first): each doc_id and hash of a text with shingles once, its rows, and if it is the one to keep of its component: the least doc_id, null last, then the least hash."""
    named, label = _components(docs, percent)
    rows = named.filter("sid IS NOT NULL").groupBy("doc_id", "crc", "sid").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = Scratch(docs.sparkSession, "op8-texts").write(rows.join(label.select("sid", "root"), "sid").select("root", "doc_id", "crc", "n_rows"), "texts")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc")
    least = rows.groupBy("root").agg(F.min(order).alias("least"))
    return rows.join(least, "root").select("doc_id", "crc", "n_rows", order.eqNullSafe(F.col("least")).alias("first"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at five words and 0.8."""
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS t FROM s),
z AS (SELECT doc_id, len(g) AS n FROM s),
f AS MATERIALIZED (SELECT doc_id, t FROM e WHERE t IN (SELECT t FROM e GROUP BY t HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM f a JOIN f b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * i >= 80 * (zx.n + zy.n - i)),
b AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.doc_id WHERE r.c < b.y)
SELECT z.doc_id, z.n AS n_shingles, m.c AS component_id FROM z JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = z.doc_id
"""
