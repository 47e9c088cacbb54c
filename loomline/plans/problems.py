"""Queries of the general data problems over the knowledge base's tables, with DuckDB SQL to check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.operators.orphans import orphan_component_references, orphan_rates
from loomline.operators.snapshots import snapshot_changes
from loomline.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference of dependencies, components.depends_on and resolved calls."""
    return orphan_component_references(*(table(spark, d, t) for t in ("dependencies", "components", "calls")))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and kind."""
    return orphan_rates(p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Additions, removals and changes between consecutive valid snapshots of each repository."""
    return snapshot_changes(table(spark, d, "component_snapshots"), table(spark, d, "snapshot_runs"))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p3_found": p3_found}


def _clean_path(x: str) -> str:
    x = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    x = f"replace({x}, chr(92), '/')"
    x = f"regexp_replace({x}, '/(\\.?/)+', '/', 'g')"
    return f"regexp_replace({x}, '^(\\./)+', '')"


def _clean_id(x: str) -> str:
    name = f"trim(regexp_replace({x}, '(?s)^.*?::', ''), chr(9)||chr(10)||chr(13)||' ')"
    return f"CASE WHEN contains({x}, '::') THEN {_clean_path(f"split_part({x}, '::', 1)")} || '::' || {name} ELSE {name} END"


_P2 = f"""
WITH refs AS (
  SELECT 'dependencies' AS ref_table, source_id, target_id, recorded_at AS t FROM dependencies
  UNION ALL SELECT 'components', id, unnest(depends_on), analyzed_at FROM components
  UNION ALL SELECT 'calls', caller, callee, recorded_at FROM calls WHERE is_resolved
), known AS (
  SELECT {_clean_id("id")} AS cid, min(first_seen_at) AS f,
         CASE WHEN count(deleted_at) = count(*) THEN max(deleted_at) END AS g
  FROM components GROUP BY 1
), judged AS (
  SELECT r.*, CASE WHEN k.cid IS NULL THEN 'missing' WHEN k.g <= r.t THEN 'deleted' WHEN k.f > r.t THEN 'late' END AS orphan_kind
  FROM (SELECT *, {_clean_id("target_id")} AS cid FROM refs WHERE regexp_matches(target_id, '\\S')) r
  LEFT JOIN known k ON k.cid = r.cid
)
SELECT DISTINCT ref_table, strftime(t, '%Y-%m') AS ref_month, source_id, target_id, orphan_kind
FROM judged WHERE orphan_kind IS NOT NULL
"""

_P3 = f"""
WITH held AS (
  SELECT run_id, repo_name, snapshot_no, row_number() OVER (PARTITION BY repo_name ORDER BY snapshot_no) AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, snapshot_no ORDER BY delivered_at DESC, run_id DESC) AS n
        FROM snapshot_runs WHERE run_state = 'complete') WHERE n = 1
), s AS (
  SELECT h.repo_name, h.i, h.snapshot_no, r.cid AS id, arg_max(coalesce(r.h, ''), r.ord) AS h
  FROM (SELECT run_id, ord, {_clean_id("id")} AS cid, left(lower(trim(content_hash)), 16) AS h FROM component_snapshots) r
  JOIN held h USING (run_id) GROUP BY ALL
)
SELECT b.repo_name, b.snapshot_no, b.id, 'added' AS change_kind FROM s b
WHERE b.i > 1 AND NOT EXISTS (SELECT 1 FROM s a WHERE a.repo_name = b.repo_name AND a.id = b.id AND a.i = b.i - 1)
UNION ALL
SELECT a.repo_name, n.snapshot_no, a.id, 'removed' FROM s a JOIN held n ON n.repo_name = a.repo_name AND n.i = a.i + 1
WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.repo_name = b.repo_name AND a.id = b.id AND a.i = b.i - 1)
UNION ALL
SELECT b.repo_name, b.snapshot_no, b.id, 'changed' FROM s b
JOIN s a ON a.repo_name = b.repo_name AND a.id = b.id AND a.i = b.i - 1
WHERE a.h <> '' AND b.h <> '' AND a.h <> b.h
"""

SQL = {
    "p2_found": _P2,
    "p2_rates": f"SELECT ref_table, ref_month, orphan_kind, count(*) AS n_orphans FROM ({_P2}) GROUP BY ALL",
    "p3_found": _P3,
}
