"""The registered queries, the smallest tables against DuckDB."""

import importlib.util
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
SOME = ["p2_found", "p4_found", "p4_key_stats", "er_normalized_table", "er_profile_source", "er_candidates", "er_features_token", "er_tfidf_cosine", "er_threshold_sweep", "er_matching_results", "er_validate_summary"]


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert {k for k in q if k.startswith("er_") and k not in s} == {"er_features_fuzzy", "er_feature_matrix"}


def test_core_does_not_import_llm():
    root = os.path.dirname(importlib.util.find_spec("linkwright").origin)
    for folder, _, files in os.walk(root):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert "linkwright.llm" not in text.read(), f


def _norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    cur = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(_norm(r[names.index(k)]) for k in sorted(names)) for r in cur.fetchall())
    df = entry.queries()[name](spark, SMALL)
    got = sorted(tuple(_norm(r[k]) for k in sorted(df.columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(names) and got == want
