"""The operators that SQL can express, against SQL, on random and adversarial tables."""

import pyarrow as pa
import pytest

from catalograph.llm import decontamination, exact_dedup, line_dedup, ngram_join, substring_dedup, url_filter

from .helpers import docs_of, edge_rows, random_texts, rows_of, same, write

CASES = {
    "op3": (decontamination.op3_decontamination, decontamination.OP3_SQL),
    "op5": (exact_dedup.op5_exact_dedup, exact_dedup.OP5_SQL),
    "op6": (substring_dedup.op6_substring_dedup, substring_dedup.OP6_SQL),
    "op8": (ngram_join.op8_ngram_join, ngram_join.OP8_SQL),
    "op9": (line_dedup.op9_line_dedup, line_dedup.OP9_SQL),
}
CLASHES = {"sid": pa.string(), "n": pa.int64(), "size": pa.int64(), "_pos": pa.int64(), "items": pa.string(), "kept": pa.bool_(), "score": pa.float64(), "content": pa.string(), "bucket": pa.int64()}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, tmp_path, name, seed):
    texts = random_texts(120, seed)
    items = [(i, t) for i, t in enumerate([*random_texts(6, seed + 50), *[" ".join(t.split()[:14]) for t in texts[:25:5]], "a A", "", texts[3], None])]
    folder = write(tmp_path, docs_of(texts), items)
    query, sql = CASES[name]
    same(query(spark, folder), folder, sql)


@pytest.mark.parametrize("name", CASES)
def test_edge_rows_and_clashing_columns(spark, tmp_path, name):
    rows = edge_rows()
    rows = rows[:-1] if name != "op5" else rows[:-1]
    folder = write(tmp_path, rows, [(1, "one two three four"), (2, rows[6][1][:400]), (3, None), (4, "")], CLASHES)
    query, sql = CASES[name]
    same(query(spark, folder), folder, sql)


@pytest.mark.parametrize("name", CASES)
def test_repeated_rows_and_null_ids_do_not_crash(spark, tmp_path, name):
    rows = [*edge_rows(), (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", None, None, None), (None, None, None, None, None), (20, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "s", 3)]
    folder = write(tmp_path, rows, [(1, "one two three four five six seven eight nine ten eleven twelve")])
    got = rows_of(CASES[name][0](spark, folder))
    assert len(got) == len(rows)
    if name == "op8":
        assert {r["component_id"] for r in got if r["doc_id"] == 5} == {5}
        assert [r["component_id"] for r in got if r["n_shingles"] == 10] == [20, 20]
    if name == "op6":
        # The null id counts as larger than 20, so its words go.
        assert {(r["doc_id"], r["n_removed"]) for r in got if r["n_words"] == 14} == {(None, 14), (20, 0)}
    if name == "op9":
        assert {(r["doc_id"], r["n_dropped"]) for r in got if r["doc_id"] in (None, 20) and r["n_lines"] == 1} >= {(20, 0), (None, 1)}
    if name == "op5":
        assert all(r["keep_id"] == 20 for r in got if r["group_size"] == 2 and r["doc_id"] == 20)
    if name == "op3":
        assert all(r["contaminated"] for r in got if r["n_words"] == 14)


@pytest.mark.parametrize("name", CASES)
def test_empty_tables(spark, tmp_path, name):
    folder = write(tmp_path, [], [])
    assert rows_of(CASES[name][0](spark, folder)) == []


def test_empty_benchmark(spark, tmp_path):
    folder = write(tmp_path, docs_of(["a b c", None]), [])
    got = rows_of(decontamination.op3_decontamination(spark, folder))
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(0, 3, 0, False), (1, 0, 0, False)]


def test_large_groups_of_copies(spark, tmp_path):
    """A third of the rows are one text, another third near copies of one: every operator keeps its result."""
    base = " ".join(f"word{i}" for i in range(60))
    near = [base.replace(f"word{i % 60}", f"other{i}") for i in range(150)]
    folder = write(tmp_path, docs_of([base] * 150 + near + random_texts(150, 9)), [(1, base)])
    for query, sql in CASES.values():
        same(query(spark, folder), folder, sql)


def test_grace_tables_recurse(spark, tmp_path):
    """Tables far smaller than the buckets spill and recurse; the result stays."""
    folder = write(tmp_path, docs_of(random_texts(200, 4)))
    out = exact_dedup.exact_dedup(spark.read.parquet(f"{folder}/documents.parquet"), table_bytes=500)
    same(out, folder, exact_dedup.OP5_SQL)


def test_open_table_compares_contents():
    t = exact_dedup.OpenTable(limit=10)
    sha = b"\0" * 32  # one hash for all: only contents tell records apart
    assert t.add(sha, b"abc", 1, 3, 7) and t.add(sha, b"abd", 1, 3, 8) and t.add(sha, b"abc", 1, 3, 2)
    assert not t.add(sha, b"longer than ten", 1, 3, 1)
    assert sorted((e[1], e[2], e[4]) for e in t.entries) == [(b"abc", 2, 2), (b"abd", 1, 8)]


def test_line_dedup_other_thresholds(spark):
    df = spark.createDataFrame([(1, "x\nshared line here"), (2, "shared line here"), (3, "Shared line here \ny")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(df, min_docs=4).collect()} == {1: "x\nshared line here", 2: "shared line here", 3: "Shared line here \ny"}
    assert {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(df, min_docs=3).collect()} == {1: "x\nshared line here", 2: "", 3: "y"}


def test_factors_name_their_reference(spark):
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a b " + " ".join(words[5:30]) + " c d")], "doc_id long, text string")
    row = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}[2]
    assert [tuple(f) for f in row.factors] == [(2, 25, 1, 5)] and row.kept == "a b c d"


def test_urls(spark, tmp_path):
    urls = [None, "", "no scheme.com/porn", "http://A.Example.COM/en/x", "http://www.example.com/en/x", "http://example.com/en", "http://x.net/es/1?q", "http://x.net/de/porn", "http://x.net/de/pornography", "http://x.org?casino", "http://free.bet.org/", "http://free.free.org/", "http://spam-farm.example.org#top", "://h/p", "a://b://c/x", "http://notexample.com/en/", "http://com/x", "http://x.net/fr/"]
    pages = pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string()), "host": pa.array([None] * len(urls), pa.string())})
    folder = write(tmp_path, [], pages=pages)
    same(url_filter.op7_url_filter(spark, folder), folder, url_filter.OP7_SQL, tables=("pages",))
    got = {r["page_id"]: r for r in rows_of(url_filter.op7_url_filter(spark, folder))}
    assert (got[3]["rule"], got[4]["rule"], got[5]["rule"]) == ("example.com/en/", "www.example.com/en/", "com/")
    assert got[10]["verdict"] == "block" and got[11]["verdict"] == "allow" and got[0]["verdict"] == "allow"


def test_urls_at_the_edges(spark, tmp_path):
    """No rows; null ids and repeated rows; a very long url; other columns with names of results; a vocabulary from a table."""
    none = pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string())})
    (tmp_path / "none").mkdir()
    assert rows_of(url_filter.op7_url_filter(spark, write(tmp_path / "none", [], pages=none))) == []
    long_ = "http://x.org/" + "a/" * 200_000 + "casino"
    urls = ["http://free-bets.example.com/", "http://m.ads-track.example.com/x", "http://blog.adult-x.example.org/", "http://m.ads-track.example.com/x", long_, None]
    pages = pa.table({"page_id": pa.array([1, None, 3, None, 5, None], pa.int64()), "url": pa.array(urls, pa.string()), "verdict": pa.array([None] * 6, pa.string()), "weight": pa.array([1] * 6, pa.int64())})
    folder = write(tmp_path, [], pages=pages)
    got = rows_of(url_filter.op7_url_filter(spark, folder))
    assert len(got) == 6 and sorted(r["weight"] for r in got) == [0.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    assert [r["verdict"] for r in got if r["page_id"] == 5] == ["block"] and {r["verdict"] for r in got if r["rule"] == "com/"} == {"allow"}
    table = spark.createDataFrame([("Track", 0.25), ("track", 0.5), ("ads", 0.5), (None, 1.0), ("", 1.0), ("x", None)], "term string, weight double")
    assert url_filter.vocabulary_of(table) == {"track": 0.5, "ads": 0.5}
    judged = url_filter.judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), (), url_filter.vocabulary_of(table))
    assert sorted(r["verdict"] for r in rows_of(judged)) == ["allow"] * 4 + ["block"] * 2


def test_signature_tree_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (40, 200, 3)]
    sets = []
    for _ in range(300):
        s = base[rng.integers(3)]
        sets.append(np.unique(np.concatenate([s[rng.random(len(s)) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 9), dtype=np.uint64)])))

    def linked(i, j):
        k = len(np.intersect1d(sets[i], sets[j]))
        return 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k)

    def roots(edges):
        p = list(range(len(sets)))

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for i, j in edges:
            p[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(len(sets))]

    tree = ngram_join.SignatureTree([len(s) for s in sets], [ngram_join.bitmap(s) for s in sets])
    assert roots(tree.forest(linked)) == roots([(i, j) for i in range(len(sets)) for j in range(i) if linked(i, j)])
