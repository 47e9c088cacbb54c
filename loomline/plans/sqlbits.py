"""Pieces of DuckDB SQL that several checking queries share."""

from __future__ import annotations

from loomline.functions.text import STOPWORDS
from loomline.plans.problems import _clean_id, _clean_path

clean_id, clean_path = _clean_id, _clean_path
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
SEP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000},;:!?。？！，；：（）(){}<>\[\]/\\]+"
FM = r"(?s)\A\x{FEFF}?---\r?\n.*?\r?\n---\r?(?:\n|\z)"


def without_fm(x: str) -> str:
    return f"regexp_replace({x}, '{FM}', '')"


def tokens(x: str) -> str:
    """The search terms of a text."""
    body = without_fm(f"regexp_replace(coalesce({x}, ''), '(?s)<!--.*?-->', '', 'g')")
    split = f"regexp_split_to_array(lower(regexp_replace({body}, '[#*`\\[\\]|>_~]', ' ', 'g')), '{SEP}')"
    return f"list_filter({split}, lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '\\p{{Nd}}+') AND NOT list_contains({STOP}, w))"


def canonical(x: str) -> str:
    """A canonical route path."""
    p = f"regexp_replace({x}, '(?s)[?#].*$', '')"
    for pattern in (r"\$\{[^}]+\}", r":[a-zA-Z_]\w*", r"\{[^}]+\}", r"<[^>]+>"):
        p = f"regexp_replace({p}, '{pattern}', '{{}}', 'g')"
    p = f"regexp_replace({p}, '^/\\{{\\}}/?', '/')"
    p = f"regexp_replace({p}, '(.)/+$', '\\1')"
    return f"CASE WHEN coalesce({x}, '') = '' THEN '/' ELSE {p} END"


EDGES = """
edges AS (
  SELECT DISTINCT src, dst FROM (SELECT id AS src, unnest(depends_on) AS dst FROM components)
  WHERE dst IS NOT NULL AND dst IN (SELECT id FROM components)
)"""

PAGES = """
pages AS (
  SELECT doc_key, CASE WHEN starts_with(source, 'notes-') THEN 'note' WHEN source = 'raw-sources' THEN 'source' ELSE 'doc' END AS source,
         title, text, updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY updated_at DESC, doc_id DESC) AS n
        FROM documents WHERE text IS NOT NULL AND doc_key IS NOT NULL) WHERE n = 1
)"""

STEM = "lower(regexp_replace(regexp_extract({}, '([^/]*)$', 1), '\\.[^.]*$', ''))"


def stem(x: str) -> str:
    return STEM.format(x)


LINES = "string_split_regex({}, '\\r?\\n')"


def lines(x: str) -> str:
    return LINES.format(x)


def title(x: str) -> str:
    """The first level-one heading of a page, links unwrapped."""
    t = f"trim(substr(list_filter(list_slice({lines(x)}, 1, 30), lambda y: starts_with(y, '# '))[1], 3), ' ')"
    t = f"regexp_replace({t}, '\\[\\[(?:[^\\]|]*\\|)?([^\\]|]+)\\]\\]', '\\1', 'g')"
    return f"regexp_replace({t}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"


def slug(x: str) -> str:
    """A title as URL part."""
    s = f"regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s-]', '', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"CASE WHEN length({s}) < 3 THEN left(sha1({x}), 8) WHEN length({s}) > 60 THEN regexp_replace(left({s}, 60), '-+$', '') ELSE {s} END"


def wikilinks(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1), lambda y: trim(y)), lambda y: y <> '')"


def hrefs(x: str) -> str:
    found = f"regexp_extract_all(coalesce({x}, ''), '\\[[^\\]]*\\]\\(([^)\\s]+?\\.md(?:#[^)\\s]*)?)\\)', 1)"
    return f"list_filter(list_transform({found}, lambda y: regexp_replace(y, '#.*$', '')), lambda y: NOT regexp_matches(y, '^[a-z]+://'))"


def fm_value(x: str, key: str) -> str:
    fm = f"regexp_extract({x}, '(?s)\\A\\x{{FEFF}}?---\\r?\\n(.*?)\\r?\\n---\\r?(?:\\n|\\z)', 1)"
    v = f"trim(regexp_extract({fm}, '(?m)^{key}:[ \\t]*(.*?)[ \\t]*$', 1))"
    v = f"regexp_replace(regexp_replace({v}, '^\"(.*)\"$', '\\1'), '^''(.*)''$', '\\1')"
    return f"nullif({v}, '')"


def fm_text(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), '(?s)\\A\\x{{FEFF}}?---\\r?\\n(.*?)\\r?\\n---\\r?(?:\\n|\\z)', 1)"


def listed(fm: str, key: str) -> str:
    """The items of a list of the front matter, inline or as dashed lines."""
    inline = f"regexp_extract({fm}, '(?m)^{key}:[ \\t]*\\[(.*?)\\][ \\t]*$', 1)"
    block = f"regexp_extract({fm}, '(?m)^{key}:[ \\t]*\\r?\\n((?:[ \\t]*-[ \\t]+.*(?:\\r?\\n|\\z))+)', 1)"
    dashed = f"list_transform(string_split_regex({block}, '\\r?\\n'), lambda x: regexp_replace(x, '^[ \\t]*-[ \\t]+', ''))"
    clean = "lambda x: regexp_replace(regexp_replace(trim(x), '^\"(.*)\"$', '\\1'), '^''(.*)''$', '\\1')"
    return f"list_filter(list_transform(CASE WHEN {inline} <> '' THEN string_split({inline}, ',') ELSE {dashed} END, {clean}), lambda x: x <> '')"


def indexable(x: str) -> str:
    """What is indexed of a page."""
    parts = []
    for key, times in (("tags", 3), ("description", 2), ("title", 2), ("aliases", 3), ("severity", 2), ("related_modules", 2)):
        value = fm_value(x, key)
        if key in ("tags", "aliases", "related_modules"):
            value = f"coalesce(nullif(array_to_string({listed(fm_text(x), key)}, ' '), ''), {value})"
        parts += [value] * times
    return f"concat_ws(chr(10), {', '.join(parts)}, nullif({without_fm(x)}, ''))"


def ranked(name: str, rows: str, terms: str) -> str:
    """BM25 scores (doc_key, score) of rows (doc_key, toks) for terms (token, times)."""
    return f"""{name}_rows AS ({rows}), {name}_terms AS ({terms}),
  {name}_post AS (SELECT doc_key, token, count(*) AS tf FROM (SELECT doc_key, unnest(toks) AS token FROM {name}_rows) GROUP BY ALL),
  {name}_df AS (SELECT token, count(*) AS df FROM {name}_post GROUP BY token), {name}_stat AS (SELECT count(*) AS nd, avg(len(toks)) AS av FROM {name}_rows),
  {name} AS (SELECT * FROM (SELECT p.doc_key, sum(greatest(0.0, ln((st.nd - df.df + 0.5) / (df.df + 0.5) + 1.0)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(r.toks) / st.av)) * t.times) AS score
    FROM {name}_post p JOIN {name}_terms t USING (token) JOIN {name}_df df USING (token) JOIN {name}_rows r USING (doc_key), {name}_stat st GROUP BY p.doc_key) WHERE score >= 0.1)"""


LINK_GRAPH = f"""
names AS (
  SELECT name, rank, max(doc_key) AS doc_key FROM (
    SELECT {stem('doc_key')} AS name, 0 AS rank, doc_key FROM pages
    UNION ALL SELECT lower(coalesce({title('text')}, title)), 1, doc_key FROM pages
    UNION ALL SELECT {slug(f"lower(coalesce({title('text')}, title))")}, 2, doc_key FROM pages
  ) WHERE name IS NOT NULL AND name <> '' GROUP BY ALL
), wl AS (
  SELECT DISTINCT doc_key AS source_doc, t AS target FROM (SELECT doc_key, unnest({wikilinks('text')}) AS t FROM pages)
), ml AS (
  SELECT DISTINCT doc_key AS source_doc, t AS target FROM (SELECT doc_key, unnest({hrefs('text')}) AS t FROM pages)
), wres AS (
  SELECT target, arg_min(doc_key, rank) AS doc_key FROM (
    SELECT DISTINCT w.target, n.rank, n.doc_key FROM (SELECT target, lower(target) AS k FROM wl UNION SELECT target, {slug('target')} FROM wl) w JOIN names n ON n.name = w.k
  ) GROUP BY target
), mres AS (
  SELECT m.source_doc, m.target, a.p AS p
  FROM ml m, LATERAL (SELECT CASE WHEN starts_with(m.target, '/') THEN substr(m.target, 2) ELSE regexp_extract(m.source_doc, '^(.*/)?[^/]*$', 1) || m.target END AS p) a
), mkeys AS (
  SELECT source_doc, target, CASE WHEN p IN (SELECT doc_key FROM pages) THEN p WHEN 'wiki/' || p IN (SELECT doc_key FROM pages) THEN 'wiki/' || p END AS doc_key FROM mres
), links AS (
  SELECT source_doc, target_doc, min(link_type) AS link_type FROM (
    SELECT w.source_doc, r.doc_key AS target_doc, 'wikilink' AS link_type FROM wl w JOIN wres r USING (target)
    UNION ALL SELECT source_doc, doc_key, 'markdown' FROM mkeys WHERE doc_key IS NOT NULL
  ) WHERE source_doc <> target_doc GROUP BY ALL
)"""
