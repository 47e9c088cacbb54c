"""The driver contract: names, columns and agreement with SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = entry.SMOKE
CHEAP = ["bm25_topk", "corpus_stats", "query_expansion", "link_graph", "module_graph", "impact_reverse", "route_unmatched", "component_changes", "suffix_matches", "file_summary", "issue_upsert", "sessions_2h", "p2_found", "p3_found", "titles", "slugs", "sample_components", "sample_calls", "sample_routes", "lint_issues", "calls_resolved", "dependency_order", "pagerank", "search_results", "route_template", "link_expansion", "external_callees"]


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p2_found", "p3_found"} <= set(q) and len(q) > 100


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return round(float(v), 6)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    got = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(cols)
    want = sorted((tuple(norm(v) for v in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(v) for v in r) for r in got.select(*cols).collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
