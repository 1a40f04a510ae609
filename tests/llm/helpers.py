"""Small adversarial tables, and comparison with SQL in DuckDB."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def random_texts(n, seed, vocabulary=40, longest=60):
    """Texts over few words: chance overlaps, copies, near copies, case and white space variants, shared passages."""
    rng = random.Random(seed)
    words = [rng.choice(["Alpha", "beta", "gamma,", "Éta", "été", "x1", "the", "of", "zeta"]) + str(rng.randrange(vocabulary)) for _ in range(vocabulary)] + ["a", "A", "é", "É"]
    passage = " ".join(rng.choice(words) for _ in range(30))
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(longest))]
        kind = rng.randrange(10)
        if kind == 0 and out:
            base = rng.choice(out)
        elif kind == 1 and out:
            w = (rng.choice(out) or "").split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            base = " ".join(w)
        elif kind == 2:
            base = " ".join(text[:20]) + " " + passage + "\n" + " ".join(text[20:])
        elif kind == 3 and out:
            base = (rng.choice(out) or "").replace(" ", "\t ").upper() if rng.random() < 0.5 else (rng.choice(out) or "").replace(" ", " \n")
        else:
            base = "".join(w + rng.choice([" ", " ", " ", "\n", "  ", ". "]) for w in text)
        out.append(base)
    return out


def edge_rows():
    """Null and empty texts, white space only, null source and lang, a repeated row, a very long text."""
    long_ = " ".join(f"w{i % 997}q{i % 13}" for i in range(20_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "src1", 0),
        (3, " \t\n\x0b\f\r ", "en", "src1", 7),
        (4, "one", "en", None, 3),
        (5, "One two three four", "fr", "src2", 18),
        (6, "one two three four", "fr", "src2", 18),
        (7, long_, "en", "src1", len(long_)),
        (8, long_ + " tail", "en", "src1", len(long_) + 5),
        (9, "123 !!! ???", "de", "src3", 11),
        (10, "single line that is long enough\nsingle line that is long enough", "de", "src3", 60),
        (11, "  SINGLE line that is long enough ", "de", "src3", 60),
    ]
    return [*rows, rows[4]]


def write(folder, rows, items=(), extra=None, **tables):
    """documents (with further columns by `extra`), benchmark and other tables as Parquet."""
    t = pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(DOCS)], schema=DOCS)
    for name, kind in (extra or {}).items():
        t = t.append_column(name, pa.array([None] * len(rows), kind))
    pq.write_table(t, f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([x for _, x in items], pa.string())}), f"{folder}/benchmark.parquet")
    for name, table in tables.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)


def docs_of(texts, start=0):
    return [(start + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def by_sql(folder, sql, tables=("documents", "benchmark")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((dict(zip(names, r)) for r in cur.fetchall()), key=str)


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def same(df, folder, sql, **kw):
    got, want = rows_of(df), by_sql(folder, sql, **kw)
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, want))
