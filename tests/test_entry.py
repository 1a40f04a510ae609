"""The driver contract."""

import pytest

import __spark_entry__ as entry


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_a_missing_extra_leaves_the_other_queries(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith(("catalograph.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "catalograph.llm", None)
    with pytest.warns(UserWarning, match="not registered"):
        again = importlib.reload(entry)
    names = set(again.queries())
    monkeypatch.undo()
    importlib.reload(entry)
    assert "tier_counts" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_some_queries_agree_with_sql(spark, sf):
    import duckdb
    import os

    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    for name in ("tokenize", "et_idf", "tier_counts", "gate_stats", "certification_by_mode", "validate_taxonomy", "graph_totals", "namespace_summary", "catalogue_resources", "agent_calls", "runtime_case_rows", "skill_rows", "process_step_rows", "certification_files", "answer_functions", "domain_clusters", "changed_pairs", "within_between", "spearman", "fitting_profiles", "convergence_curve"):
        got = entry.queries()[name](spark, sf)
        cur = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(got.columns), name
        key = lambda r: str(sorted(((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.items()), key=str))
        assert sorted(key(r.asDict()) for r in got.collect()) == sorted(key(dict(zip(names, r))) for r in cur.fetchall()), name
