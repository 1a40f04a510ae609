"""Small tables for the core queries."""

import pyarrow as pa
import pyarrow.parquet as pq

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def write(folder, rows, items=(), **tables):
    """documents, benchmark and other tables as Parquet."""
    t = pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(DOCS)], schema=DOCS)
    pq.write_table(t, f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([x for _, x in items], pa.string())}), f"{folder}/benchmark.parquet")
    for name, table in tables.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)
