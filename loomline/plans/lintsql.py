"""DuckDB SQL of the documentation checks, one common table expression a check, over the same operands as `plans.upkeep`."""

from __future__ import annotations

from loomline.plans import sqlbits as q
from loomline.plans.graphs import _COND

TODAY = "DATE '2025-12-31'"
_P = q.clean_path("relative_path")
_BASE = "regexp_extract({}, '([^/]*)$', 1)"
_MD = f"lower(regexp_replace({_BASE}, '\\.md$', ''))"
_WIKI = "source = 'doc' AND NOT regexp_matches(lower(doc_key), '(^|/)(index|log|overview)\\.md$')"


#: Lines of pages with whether they stand in a fenced block or are a fence.
LINES = f"""
raw_lines AS (SELECT doc_key, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_key, {q.lines("text")} AS ls FROM pages)),
page_lines AS (SELECT doc_key, no, line, fence = 1 OR sum(fence) OVER (PARTITION BY doc_key ORDER BY no) % 2 = 1 AS fenced
  FROM (SELECT *, CASE WHEN regexp_matches(line, '^[ \\t]*```') THEN 1 ELSE 0 END AS fence FROM raw_lines))"""

CHECKS = f"""
front AS (SELECT doc_key, source, text, {q.fm_text("text")} AS fm FROM pages),
fields AS (SELECT doc_key, source, fm, {q.fm_value("text", "status")} AS status, {q.fm_value("text", "type")} AS type, {q.fm_value("text", "stale_after")} AS stale_after,
  {q.fm_value("text", "superseded_by")} AS superseded_by, {q.fm_value("text", "date")} AS day FROM front),
f AS (SELECT DISTINCT repo_name, id, array_to_string(list_slice(string_split({_P}, '/'), 1, 2), '/') AS folder FROM components),
mods AS (SELECT DISTINCT repo_name AS module, CAST(NULL AS VARCHAR) AS component_id FROM f UNION ALL SELECT folder, id FROM f),
href_lines AS (SELECT DISTINCT doc_key, no, h AS href, CASE WHEN starts_with(h, '/') THEN substr(h, 2) ELSE regexp_extract(doc_key, '^(.*/)?[^/]*$', 1) || h END AS p
  FROM (SELECT doc_key, no, unnest({q.hrefs("line")}) AS h FROM page_lines WHERE NOT fenced)),
stale AS (SELECT doc_key, no, href FROM href_lines WHERE {_MD.format("href")} NOT IN (SELECT regexp_replace(lower(module), '[\\s/\\\\]+', '_', 'g') FROM mods)
  AND {_MD.format("href")} NOT IN (SELECT {_MD.format("doc_key")} FROM pages)),
broken AS (SELECT doc_key, no, href FROM href_lines WHERE p NOT IN (SELECT doc_key FROM pages) AND 'wiki/' || p NOT IN (SELECT doc_key FROM pages) AND (doc_key, no) NOT IN (SELECT (doc_key, no) FROM stale)),
claim AS (SELECT doc_key, count(*) AS claims, count(*) FILTER (contains(line, '[candidate]') OR NOT regexp_matches(near, '\\[\\^src:|\\]\\([^)]*\\)|(?i)evidence:')) AS unsupported
  FROM (SELECT doc_key, line, concat_ws(chr(10), line, lead(line, 1) OVER w, lead(line, 2) OVER w) AS near FROM raw_lines WINDOW w AS (PARTITION BY doc_key ORDER BY no))
  WHERE regexp_matches(line, '\\(confidence:\\s*[^)]+\\)') GROUP BY doc_key),
hit AS (SELECT doc_key, CAST(max(loaded_at) AS DATE) AS last_hit FROM documents WHERE lang = 'en' GROUP BY doc_key),
lone AS (SELECT DISTINCT id, {_P} AS p FROM components WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)),
cover AS (SELECT count(*) AS n, count(*) FILTER (id IN (SELECT component_id FROM mods)) AS k FROM (SELECT DISTINCT id FROM components)),
issues AS (
  SELECT 'stale_refs' AS "check", 'error' AS severity, doc_key AS file, CAST(no AS INT) AS line, 'stale reference: ' || href AS message FROM stale
  UNION ALL SELECT 'broken_links', 'error', doc_key, no, 'broken link: ' || href FROM broken
  UNION ALL SELECT 'undocumented', 'warning', dst, NULL, 'undocumented, dependents: ' || n FROM (SELECT dst, count(*) AS n FROM edges GROUP BY dst) WHERE n >= 5 AND dst NOT IN (SELECT component_id FROM mods WHERE component_id IS NOT NULL)
  UNION ALL SELECT * FROM (SELECT 'cycles', 'info', g, NULL, 'cycle of ' || count(*) FROM comp GROUP BY g HAVING count(*) > 1 ORDER BY g LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'isolated_components', 'info', p, NULL, 'isolated components: ' || count(*) FROM lone GROUP BY p ORDER BY count(*) DESC, p LIMIT 20)
  UNION ALL SELECT 'coverage', 'info', NULL, NULL, 'coverage: ' || CAST(round(100.0 * k / n, 2) AS DOUBLE) FROM cover
  UNION ALL SELECT 'orphan_pages', 'warning', doc_key, NULL, 'no page links here' FROM pages WHERE {_WIKI} AND doc_key NOT IN (SELECT doc_key FROM wres UNION SELECT doc_key FROM mkeys WHERE doc_key IS NOT NULL)
  UNION ALL SELECT 'no_outlinks', 'info', doc_key, NULL, 'links to no page' FROM pages WHERE {_WIKI} AND doc_key NOT IN (SELECT source_doc FROM wl UNION SELECT source_doc FROM ml)
  UNION ALL SELECT * FROM (SELECT 'missing_aliases', 'info', min(doc_key), NULL, 'pages without aliases: ' || count(*) FROM front WHERE {_WIKI} AND len({q.listed("fm", "aliases")}) = 0 HAVING count(*) > 0)
  UNION ALL SELECT 'stale_sources', 'warning', doc_key, NULL, 'retracted source: ' || name FROM (SELECT DISTINCT doc_key, unnest(regexp_extract_all(text, '\\[\\^src:([^:\\]]+)(?::[^\\]]*)?\\]', 1)) AS name FROM pages) WHERE name IN (SELECT repo_name FROM components)
  UNION ALL SELECT 'superseded_pages', 'info', doc_key, NULL, 'superseded by ' || superseded_by FROM fields WHERE superseded_by IS NOT NULL
  UNION ALL SELECT 'overview_stale', 'warning', doc_key, NULL, 'overview is stale' FROM documents WHERE doc_key IS NOT NULL GROUP BY doc_key HAVING max(CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END) = 1
  UNION ALL SELECT 'unsupported_claims', 'warning', doc_key, NULL, 'unsupported claims: ' || unsupported || ' of ' || claims FROM claim WHERE unsupported > 0.3 * claims
  UNION ALL SELECT 'stale_notes', 'warning', doc_key, NULL, 'stable, old and not searched for' FROM fields LEFT JOIN hit USING (doc_key) WHERE source = 'note' AND CASE WHEN lower(trim(status)) = 'confirmed' THEN 'stable' ELSE lower(trim(status)) END = 'stable'
    AND try_cast(left(day, 10) AS DATE) + 90 < {TODAY} AND coalesce(last_hit + 60 < {TODAY}, true)
  UNION ALL SELECT 'note_clusters', 'info', module, NULL, note_type || ' notes: ' || count(DISTINCT doc_key) FROM (SELECT doc_key, coalesce(type, 'note') AS note_type, unnest({q.listed("fm", "related_modules")}) AS module FROM fields WHERE source = 'note') GROUP BY module, note_type HAVING count(DISTINCT doc_key) >= 3
  UNION ALL SELECT 'conformance', 'error', doc_key, NULL, 'no front matter' FROM fields WHERE fm = ''
  UNION ALL SELECT 'conformance', 'error', doc_key, NULL, 'no type' FROM fields WHERE fm <> '' AND type IS NULL
  UNION ALL SELECT 'conformance', 'warning', doc_key, NULL, 'unknown status: ' || status FROM fields WHERE fm <> '' AND lower(status) NOT IN ('draft', 'stable', 'deprecated')
  UNION ALL SELECT 'conformance', 'warning', doc_key, NULL, 'verified is not a list' FROM fields WHERE regexp_matches(fm, '(?m)^verified:[ \\t]*\\r?\\n[ \\t]+[A-Za-z_]+:')
  UNION ALL SELECT 'conformance', 'warning', doc_key, NULL, 'expired: ' || stale_after FROM fields WHERE fm <> '' AND try_cast(left(stale_after, 10) AS DATE) < {TODAY}
)"""
WITH = f"WITH RECURSIVE {q.PAGES.strip()}, {q.LINK_GRAPH.strip()}, {q.EDGES.strip()}, {_COND}, {LINES.strip()}, {CHECKS.strip()}"
SQL = {
    "lint_issues": f'{WITH} SELECT "check", severity, file, line, message FROM issues',
    "lint_counts": f'{WITH} SELECT "check", severity, count(*) AS n FROM issues GROUP BY ALL',
    "health_score": f"""{WITH}, n AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM issues)
        SELECT errors, warnings, infos, greatest(0, 100 - 10 * errors - 3 * warnings - infos) AS score FROM n""",
}
