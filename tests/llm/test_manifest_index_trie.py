"""The manifest, the multi-index and the trie against SQL or brute force."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalograph.llm import merkle, multi_index, prefix_trie
from catalograph.llm.common import Scratch
from catalograph.llm.numbering import dense_names, number_within

from .helpers import docs_of, edge_rows, random_texts, rows_of, same, write

CONVS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])


def write_table(folder, name, schema, rows, extra=()):
    t = pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
    for c in extra:
        t = t.append_column(c, pa.array([None] * len(rows), pa.int64()))
    pq.write_table(t, f"{folder}/{name}.parquet")
    return str(folder)


def test_numbers_are_dense_and_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k, v) for v in range(300) for k in (["a"] if v % 3 else ["a", None])], "k string, v int")
    got = number_within(df.repartition(5), "k", [F.col("v")], Scratch(spark, "t"), "n").collect()
    assert sorted(r.idx for r in got if r.k is None) == list(range(100)) and {r.n for r in got if r.k is None} == {100}
    assert [r.v for r in sorted((r for r in got if r.k == "a"), key=lambda r: r.idx)] == list(range(300))
    names, end = dense_names(df.select("v"), Scratch(spark, "t"), "d", 7)
    assert sorted(r.name for r in names.collect()) == list(range(7, 307)) and end == 307


# The manifest.


def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def _siblings(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i - i % 3
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 3])))
        i //= 3
    return out


def _manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _h("".join(map(enc, (r[0], r[3], r[2], r[4], text))))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    top = _tree([t[-1][0] for t in trees])
    out = []
    for n, (s, t) in enumerate(zip(names, trees)):
        for i, x in enumerate(sorted(by[s], key=lambda x: x[:3])):
            r, path = x[3], _siblings(t, i) + _siblings(top, n)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            h = leaf(r, r[1].replace("\n", "")) if tampered else x[2]
            for left, right in path:
                h = _h(left + h + right)
            out.append({"doc_id": r[0], "leaf": x[2], "subroot": t[-1][0], "root": top[-1][0], "proof_sha256": _h("".join(a + b for a, b in path)), "folded_root": h, "verified": h == top[-1][0]})
    return sorted(out, key=str)


def test_manifest_is_the_sql_and_the_brute_force(spark, tmp_path):
    rows = [*docs_of(random_texts(100, 3)), *[(500 + i, "a\nb", None, None, None) for i in range(10)], (900, "lone\n", "en", "é", 1), (901, "lone", "en", "z", 1)]
    folder = write(tmp_path, rows, extra={"key": pa.string(), "idx": pa.int64(), "hash": pa.string(), "path": pa.int64()})
    got = merkle.op11_merkle_manifest(spark, folder)
    same(got, folder, merkle.OP11_SQL)
    assert rows_of(got) == _manifest(rows)
    assert {r["verified"] for r in rows_of(got)} == {True, False}


def test_manifest_of_edge_rows(spark, tmp_path):
    rows = [*edge_rows(), *[(None, f"no id {i % 2}", None, None, None) for i in range(7)], (5, "other text of five", "fr", "src2", 1)]
    assert rows_of(merkle.op11_merkle_manifest(spark, write(tmp_path, rows))) == _manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(i, f"t\n{i}", "en", None, 1) for i in range(n)]
    assert rows_of(merkle.op11_merkle_manifest(spark, write(tmp_path, rows))) == (_manifest(rows) if n else [])


def test_manifest_of_long_text_and_other_fanout(spark, tmp_path):
    rows = [(i, "x y\n" * 700_000 if i == 2 else "t", "en", "s", 1) for i in range(6)]
    docs = spark.read.parquet(write(tmp_path, rows) + "/documents.parquet")
    m = merkle.manifest(docs, F.col("text"), F.lit(False), Scratch(spark, "t"), fanout=2)
    got = m.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == 6 and all(r.folded == r.root and len(r.path) == 3 for r in got)


# The trie.


def conversations(n, seed):
    rng, out = random.Random(seed), []
    words = ["a", "b", "a b", "c\x0bd", "é", "", None]
    for c in range(n):
        for t in range(rng.randrange(9)):
            out.append((c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]) if t else "user", rng.choice(words[: 2 if t < 3 else 7])))
    return out


def _trie(rows):
    own = {}
    key = lambda r, t: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, key(role, text), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    count = lambda t: len([w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    saved = {k: (len(v) - 1) * count(k[-1][1]) if k else 0 for k, v in nodes.items()}
    out = []
    for k, v in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c in v if len(seqs[c]) == len(k)))
        out.append({"conv_id": min(v), "depth": len(k), "parent_conv_id": min(nodes[k[:-1]]) if k else None, "n_convs": len(v), "n_children": len(children.get(k, [])), "n_leaves": sum(x not in children for x in below), "saved_tokens": sum(saved[x] for x in below), "ends_sha256": hashlib.sha256(ends.encode()).hexdigest()})
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_the_sql_and_the_brute_force(spark, tmp_path, seed):
    rows = [*conversations(70, seed), (None, 1, "user", "a"), (None, None, None, None), (3, 1, "user", "a"), (3, 1, "user", "a")]
    folder = write_table(tmp_path, "conversations", CONVS, rows, ("node", "pos", "key", "len"))
    got = prefix_trie.op13_prefix_trie(spark, folder)
    same(got, folder, prefix_trie.OP13_SQL, tables=("conversations",))
    assert rows_of(got) == _trie(rows)


def test_trie_with_small_chunks_copies_and_long_conversations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, t, "user", "a b") for c in range(40, 60) for t in range(3)] + [(7, t, "user", str(t % 2)) for t in range(37)] + [(8, t, "user", str(t % 2)) for t in range(35)]
    assert rows_of(prefix_trie.op13_prefix_trie(spark, write_table(tmp_path, "conversations", CONVS, rows))) == _trie(rows)


def test_trie_without_turns(spark, tmp_path):
    assert rows_of(prefix_trie.op13_prefix_trie(spark, write_table(tmp_path, "conversations", CONVS, []))) == []
    # Turns that a rebuilt conversation leaves out leave it without any.
    few = [(c, 0, None, None) for c in (21, 22, 23, 24, 25)]
    got = rows_of(prefix_trie.op13_prefix_trie(spark, write_table(tmp_path, "conversations", CONVS, few)))
    assert got == _trie(few) and any(r["depth"] == 0 for r in got)


# The multi-index.


def vectors(n, seed, dims=8, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[:copies] = x[:1]
    return [(i, [float(v) for v in x[i]], 0) for i in range(n)]


def _brute(rows, k=20):
    n = max((len(v) for _, v, _ in rows if v), default=0)
    ok = [(i, np.array(v, float)) for i, v, _ in rows if v and len(v) == n and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([v for _, v in ok])
    out = {}
    for at, (q, v) in enumerate(ok):
        if q is not None and q % 20 == 0:
            s = multi_index.exact_scores(np.repeat(v[None], len(x), 0), x)
            best = sorted((-s[j], ok[j][0] is None, ok[j][0] or 0) for j in range(len(ok)) if j != at)[:k]
            out.setdefault(q, []).append([(None if none else i, -m) for m, none, i in best])
    return out


def _found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_pairs_of_centroids_come_in_order():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 6), (7, 1), (9, 13)):
        a, b = rng.normal(size=n).round(1), rng.normal(size=m).round(1)
        got = list(multi_index.traverse(a, b))
        assert len({(i, j) for _, i, j in got}) == n * m == len(got)
        assert [x[0] for x in got] == heapq.nlargest(n * m, (p + q for p in a for q in b))


def test_search_with_bounds_is_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    monkeypatch.setattr(multi_index, "QUERIES", 8)
    rows = vectors(700, 1, copies=150)
    df = spark.read.parquet(write_table(tmp_path, "embeddings", VECTORS, rows) + "/embeddings.parquet")
    index = multi_index.MultiIndex(multi_index.usable(df), Scratch(spark, "t"))
    got = _found(index.search(F.col("vec_id") % 20 == 0, first=40, slack=None))
    assert {q: [x[1:] for x in v] for q, v in got.items()} == {q: v[0] for q, v in _brute(rows).items()}
    assert all([x[0] for x in v] == list(range(1, 21)) for v in got.values())


def test_recall_of_the_query(spark, tmp_path):
    rows = vectors(3000, 2, dims=16)
    got, want = _found(multi_index.op12_nearest_neighbours(spark, write_table(tmp_path, "embeddings", VECTORS, rows))), _brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({x[1] for x in got[q]} & {i for i, _ in want[q][0]}) / 20 for q in got]
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("dims", [1, 3])
def test_vectors_that_take_no_part(spark, tmp_path, dims):
    good = vectors(30, 4, dims)
    nan = float("nan")
    bad = [(100, None, 0), (120, [], 0), (140, [0.0] * dims, 0), (160, [nan] * dims, 0), (180, [float("inf")] + [1.0] * (dims - 1), 0), (200, [None] * dims, 0), (220, [1.0] * (dims + 2), 0)]
    rows = [*good, *bad, (None, good[3][1], 0), (None, good[3][1], 0), (20, good[20][1], 0)]
    got = multi_index.op12_nearest_neighbours(spark, write_table(tmp_path, "embeddings", VECTORS, rows, ("q", "row", "floor", "v"))).collect()
    want = _brute([*good, *rows[-3:]])
    assert {r.query_id for r in got} == {0, 20}
    for q in (0, 20):
        mine = sorted(((r["rank"], r.vec_id is None, r.vec_id or 0, r.score) for r in got if r.query_id == q))
        assert mine == sorted((n + 1, i is None, i or 0, s) for v in want[q] for n, (i, s) in enumerate(v))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, tmp_path, n):
    rows = vectors(n, 6)
    assert len(multi_index.op12_nearest_neighbours(spark, write_table(tmp_path, "embeddings", VECTORS, rows)).collect()) == (1 if n == 2 else 0)
