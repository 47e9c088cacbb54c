"""Graph queries over the components' dependencies, with their SQL. Modules are the repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.ids import clean_path
from loomline.functions.scalar import clean_language
from loomline.operators import graph as g
from loomline.operators import resolve
from loomline.plans import sqlbits as q
from loomline.session import ensure_checkpoint_dir
from loomline.sources.tables import table


def _components(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "components")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return g.edges_of(_components(spark, d))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).select(F.col("id").alias("component_id"), F.col("repo_name").alias("module")).dropDuplicates(["component_id"])


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """Repositories and the folders below them as a module tree of two levels, components in the folders."""
    c = _components(spark, d).dropDuplicates(["id"]).select("id", "repo_name", F.array_join(F.slice(F.split(clean_path("relative_path"), "/"), 1, 2), "/").alias("folder"))
    low = c.select(F.col("folder").alias("module"), F.col("repo_name").alias("parent"), F.lit(1).alias("depth"), F.col("id").alias("component_id"))
    none = F.lit(None).cast("string")
    high = c.select(F.col("repo_name").alias("module"), none.alias("parent"), F.lit(0).alias("depth"), none.alias("component_id")).distinct()
    rows = high.unionByName(low)
    return rows.withColumn("preorder", F.xxhash64("module"))


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return g.high_impact(_edges(spark, d), 1, 3).select("id")


def _reached(spark: SparkSession, d: str, **how) -> DataFrame:
    """What the three most used components reach, over edges that are made once."""
    ensure_checkpoint_dir(spark)
    e = _edges(spark, d).checkpoint()
    return g.impact(e, g.high_impact(e, 1, 3).select("id"), **how)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """G1: distinct dependencies between known components."""
    return _edges(spark, d)


def edges_reversed(spark: SparkSession, d: str) -> DataFrame:
    """All dependencies in both directions."""
    return g.both_directions(_edges(spark, d))


def in_degree(spark: SparkSession, d: str) -> DataFrame:
    """Direct dependents of each component."""
    return g.in_degrees(_edges(spark, d))


def high_impact(spark: SparkSession, d: str) -> DataFrame:
    """The 20 components with most dependents."""
    return g.high_impact(_edges(spark, d))


def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Components without dependencies either way."""
    return g.isolated_nodes(_components(spark, d), _edges(spark, d))


def impact_reverse(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the three most used components, with the depth."""
    return _reached(spark, d)


def impact_forward(spark: SparkSession, d: str) -> DataFrame:
    """What the three most used components depend on."""
    return _reached(spark, d, direction="depends_on")


def impact_both(spark: SparkSession, d: str) -> DataFrame:
    """Both directions, the smaller depth."""
    return _reached(spark, d, direction="both")


def impact_paths(spark: SparkSession, d: str) -> DataFrame:
    """Reached components with one shortest path."""
    r = _reached(spark, d, paths=True)
    return r.select("id", "depth", F.array_join("path", " > ").alias("path"))


def impact_by_module(spark: SparkSession, d: str) -> DataFrame:
    """Reached components per repository."""
    return g.impact_by_module(_reached(spark, d), _index(spark, d))


def module_graph(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies between repositories."""
    return g.module_graph(_edges(spark, d), _index(spark, d))


def module_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """What each repository depends on and what depends on it."""
    n = g.module_neighbours(_edges(spark, d), _index(spark, d))
    return n.select("module", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("depended_by", ",").alias("depended_by"))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """PageRank to its tolerance."""
    return g.pagerank(_edges(spark, d)).select("id", F.round("score", 9).alias("score"))


def pagerank_compat(spark: SparkSession, d: str) -> DataFrame:
    """The variant that divides by the number of dependents, to its tolerance."""
    return g.pagerank(_edges(spark, d), compat=True).select("id", F.round("score", 9).alias("score"))


def reading_guide(spark: SparkSession, d: str) -> DataFrame:
    """The ten repositories with most PageRank, run to its tolerance."""
    return g.module_scores(g.pagerank(_edges(spark, d)), _index(spark, d)).select("module", F.round("score", 7).alias("score"), "n")


def scc(spark: SparkSession, d: str) -> DataFrame:
    """The cycles' components."""
    return g.components_scc(_edges(spark, d))


def topological_levels(spark: SparkSession, d: str) -> DataFrame:
    """Dependency levels of all components with edges, those of a cycle together."""
    return g.topological_levels(_edges(spark, d))


def condensation(spark: SparkSession, d: str) -> DataFrame:
    """The acyclic graph of all components."""
    return g.condensation(_edges(spark, d))


def dependency_order(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies first, over the whole graph."""
    return g.topological_levels(_edges(spark, d), _components(spark, d))


def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best connected components."""
    return g.degree_centrality(_edges(spark, d), 50)[0]


def central_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges between the 50 best connected components."""
    return g.degree_centrality(_edges(spark, d), 50)[1]


def doc_candidates(spark: SparkSession, d: str) -> DataFrame:
    """what is documented."""
    return g.doc_candidates(_components(spark, d), _edges(spark, d))


def processing_order(spark: SparkSession, d: str) -> DataFrame:
    """Modules with their depth, children first."""
    return g.processing_order(_modules(spark, d)).select("module", "parent", "depth")


def affected_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules that a change of the most used component reaches, and their parents."""
    return g.affected_modules(_modules(spark, d), _edges(spark, d), g.high_impact(_edges(spark, d), 1, 1).select("id"))


def call_context(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the three most used components."""
    return g.call_context(_edges(spark, d), _starts(spark, d), _components(spark, d)).select("id", "name", F.array_join("parameters", ",").alias("parameters"))


def calls_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """The first call of each pair."""
    return resolve.dedup_calls(table(spark, d, "calls")).select("caller", "callee", "ord")


def calls_resolved(spark: SparkSession, d: str) -> DataFrame:
    """What each distinct call leads to, by unique names in the caller's language, then anywhere."""
    calls = resolve.dedup_calls(table(spark, d, "calls"))
    return resolve.resolve_calls(calls, _components(spark, d)).select("caller", "callee", "target")


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of calls, unresolved names falling back to the first component of the name."""
    c = _components(spark, d)
    return resolve.call_edges(resolve.resolve_calls(resolve.dedup_calls(table(spark, d, "calls")), c), c)


def external_callees(spark: SparkSession, d: str) -> DataFrame:
    """callees outside the repositories, by kind and the caller's language, and some of every language's own."""
    c = _components(spark, d).select(F.col("id").alias("caller"), clean_language("language").alias("lang")).dropDuplicates(["caller"])
    calls = table(spark, d, "calls").where("callee is not null").join(c, "caller").select("callee", "lang")
    calls = calls.unionByName(spark.createDataFrame(CALLEES, "callee string, lang string"))
    kind = F.coalesce(resolve.external_callee("callee", "lang", ("len", "super")), F.lit("component"))
    return calls.groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


#: Callees of each language whose kind is known.
CALLEES = [
    ("os.path.join", "python"), ("len", "python"), ("numpy.array", "python"), ("java.util.List.of", "java"), ("javax.x.Y", "java"), ("com.a.B", "java"), ("System.Console.Write", "csharp"), ("Foo.Bar", "csharp"),
    ("fmt.Println", "go"), ("gin.New", "go"), ("console.log", "javascript"), ("lodash.map", "javascript"), ("JSON.parse", "typescript"), ("std::move", "cpp"), ("MAX_OF", "cpp"), ("MAX_OF", "java"), ("ASSERT", "c"), ("a::b", "cpp"),
]


QUERIES = {f.__name__ if f.__name__ not in ("edges",) else "dependency_edges": f for f in (
    edges, edges_reversed, in_degree, high_impact, isolated_nodes, impact_reverse, impact_forward, impact_both, impact_paths, impact_by_module, module_graph,
    module_neighbours, pagerank, pagerank_compat, reading_guide, scc, topological_levels, condensation, dependency_order, degree_centrality, central_edges, doc_candidates,
    processing_order, affected_modules, call_context, calls_deduplicated, calls_resolved, call_edges, external_callees,
)}

_E = f"WITH RECURSIVE {q.EDGES.strip()}"
_START = "starts AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT {n})"


def _reach(condition: str, step: str, n: int = 3) -> str:
    return f"{_START.format(n=n)}, r AS (SELECT id, 0 AS depth FROM starts UNION SELECT {step}, r.depth + 1 FROM r JOIN edges e ON {condition} WHERE r.depth < 10)"


_REV, _FWD = _reach("e.dst = r.id", "e.src"), _reach("e.src = r.id", "e.dst")
_BOTH = f"""{_START.format(n=3)}, r1 AS (SELECT id, 0 AS depth FROM starts UNION SELECT e.src, r1.depth + 1 FROM r1 JOIN edges e ON e.dst = r1.id WHERE r1.depth < 10),
  r2 AS (SELECT id, 0 AS depth FROM starts UNION SELECT e.dst, r2.depth + 1 FROM r2 JOIN edges e ON e.src = r2.id WHERE r2.depth < 10)"""
#: The components of cycles from the pairs that reach each other, the acyclic graph of components and its longest ways.
_COND = """c AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT c.a, e.dst FROM c JOIN edges e ON e.src = c.b),
  mutual AS (SELECT x.a, min(x.b) AS least FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
  nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), comp AS (SELECT id, least(id, coalesce(least, id)) AS g FROM nodes LEFT JOIN mutual ON a = id),
  cond AS (SELECT DISTINCT x.g AS src, y.g AS dst FROM edges e JOIN comp x ON x.id = e.src JOIN comp y ON y.id = e.dst WHERE x.g <> y.g)"""
_LEVELS = f"{_COND}, l AS (SELECT DISTINCT g, 0 AS level FROM comp UNION SELECT cond.src, l.level + 1 FROM l JOIN cond ON cond.dst = l.g), lv AS (SELECT id, level FROM comp JOIN (SELECT g, max(level) AS level FROM l GROUP BY g) USING (g))"
_IDX = "idx AS (SELECT DISTINCT id, repo_name AS module FROM components)"


def _rank(by: str) -> str:
    return f"""{_E}, nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
      sh AS (SELECT {by} AS id, count(*) AS share FROM edges GROUP BY 1), w AS (SELECT e.src, e.dst, sh.share FROM edges e JOIN sh ON sh.id = e.src),
      pr AS (SELECT id, 1.0 / n.n AS s, 0 AS k, CAST(1 AS DOUBLE) AS change FROM nodes, n UNION ALL
        SELECT id, fresh, k + 1, sum(abs(fresh - s)) OVER () FROM (
          SELECT p.id, p.s, p.k, 0.15 / n.n + 0.85 * coalesce(got.s, 0) AS fresh
          FROM pr p CROSS JOIN n LEFT JOIN (SELECT w.dst AS id, sum(q.s / w.share) AS s FROM w JOIN pr q ON q.id = w.src GROUP BY w.dst) got ON got.id = p.id
          WHERE p.k < 100 AND p.change >= 1e-6)),
      ranks AS (SELECT id, s AS score FROM pr WHERE k = (SELECT max(k) FROM pr))"""


_LANG = "CASE WHEN language IS NULL OR lower(trim(language)) IN ('', 'none', 'null', 'unknown') THEN 'unknown' ELSE lower(trim(language)) END"
#: What each distinct call leads to: all its names are tried, the caller's language first; the first that one component has counts.
_RESOLVED = f"""fn AS (SELECT id, any_value(name) AS name, any_value(qualified_name) AS qn, string_split(any_value(qualified_name), '.') AS parts, any_value({_LANG}) AS lang, any_value(lower(component_type)) AS ct FROM components GROUP BY id),
  nm AS (SELECT id, lang, unnest([name, split_part(id, '::', -1), parts[-1], CASE WHEN len(parts) >= 2 THEN array_to_string(parts[-2:], '.') END]) AS k FROM fn),
  keys AS (SELECT id, lang, 'exact' AS ix, unnest([id, qn, name]) AS k FROM fn UNION SELECT id, lang, 'simple', k FROM nm UNION SELECT id, lang, 'simple', split_part(k, '.', -1) FROM nm),
  held AS (SELECT '*' AS scope, ix, k, min(id) AS target, min(lang) AS target_lang FROM keys WHERE k <> '' GROUP BY ix, k HAVING count(DISTINCT id) = 1
    UNION ALL SELECT lang, ix, k, min(id), lang FROM keys WHERE k <> '' GROUP BY lang, ix, k HAVING count(DISTINCT id) = 1),
  asked AS (SELECT c.caller, c.callee, fn.lang, CASE WHEN contains(callee, '::') THEN split_part(callee, '::', -1) END AS after, CASE WHEN contains(callee, '.') THEN callee END AS dotted,
      CASE WHEN fn.lang IN ('java', 'csharp') AND NOT contains(callee, '.') AND len(parts) >= 2 THEN array_to_string(parts[:len(parts) - CASE WHEN ct = 'method' AND len(parts) >= 3 THEN 2 ELSE 1 END], '.') || '.' || callee END AS inside
    FROM (SELECT DISTINCT caller, callee FROM calls WHERE caller IS NOT NULL AND callee IS NOT NULL) c LEFT JOIN fn ON fn.id = c.caller),
  tried AS (SELECT caller, callee, lang, unnest([{{'r': 0, 'ix': 'exact', 'k': callee}}, {{'r': 1, 'ix': 'exact', 'k': after}}, {{'r': 2, 'ix': 'simple', 'k': after}}, {{'r': 3, 'ix': 'simple', 'k': dotted}},
    {{'r': 4, 'ix': 'simple', 'k': split_part(dotted, '.', -1)}}, {{'r': 5, 'ix': 'exact', 'k': inside}}, {{'r': 6, 'ix': 'simple', 'k': callee}}]) AS t FROM asked),
  found AS (SELECT caller, callee, lang, arg_min(h.target, t.r + CASE WHEN scope = '*' THEN 7 ELSE 0 END) AS target, arg_min(h.target_lang, t.r + CASE WHEN scope = '*' THEN 7 ELSE 0 END) AS target_lang
    FROM tried JOIN held h ON h.ix = t.ix AND h.k = t.k AND (scope = '*' OR (scope = lang AND lang <> 'unknown')) GROUP BY caller, callee, lang),
  resolved AS (SELECT a.caller, a.callee, CASE WHEN NOT (coalesce(f.lang <> 'unknown', false) AND target_lang <> 'unknown' AND target_lang <> f.lang) THEN target END AS target FROM asked a LEFT JOIN found f ON f.caller = a.caller AND f.callee = a.callee)"""
_KIND = "lower(trim(CASE WHEN regexp_matches(coalesce(component_type, ''), '\\S') THEN component_type ELSE node_type END))"
SQL = {
    "dependency_edges": f"{_E} SELECT src, dst FROM edges",
    "edges_reversed": f"{_E} SELECT src, dst, 'depends_on' AS direction FROM edges UNION ALL SELECT dst, src, 'depended_by' FROM edges",
    "in_degree": f"{_E} SELECT dst AS id, count(*) AS dependents FROM edges GROUP BY dst",
    "high_impact": f"{_E} SELECT dst AS id, count(*) AS dependents FROM edges GROUP BY dst HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 20",
    "isolated_nodes": f"{_E} SELECT DISTINCT id FROM components WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "impact_reverse": f"{_E}, {_REV} SELECT id, min(depth) AS depth FROM r GROUP BY id",
    "impact_forward": f"{_E}, {_FWD} SELECT id, min(depth) AS depth FROM r GROUP BY id",
    "impact_both": f"{_E}, {_BOTH} SELECT id, min(depth) AS depth FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY id",
    "impact_by_module": f"{_E}, {_REV}, {_IDX} SELECT module, count(*) AS n, max(depth) AS max_depth FROM (SELECT id, min(depth) AS depth FROM r GROUP BY id) JOIN idx USING (id) GROUP BY module",
    "module_graph": f"{_E}, {_IDX} SELECT DISTINCT a.module AS src, b.module AS dst FROM edges e JOIN idx a ON a.id = e.src JOIN idx b ON b.id = e.dst WHERE a.module <> b.module",
    "module_neighbours": f"""{_E}, {_IDX}, m AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM edges e JOIN idx a ON a.id = e.src JOIN idx b ON b.id = e.dst WHERE a.module <> b.module)
        SELECT coalesce(o.module, i.module) AS module, coalesce(o.x, '') AS depends_on, coalesce(i.x, '') AS depended_by
        FROM (SELECT src AS module, string_agg(dst, ',' ORDER BY dst) AS x FROM m GROUP BY src) o FULL JOIN (SELECT dst AS module, string_agg(src, ',' ORDER BY src) AS x FROM m GROUP BY dst) i ON i.module = o.module""",
    "pagerank": _rank("src") + " SELECT id, round(score, 9) AS score FROM ranks",
    "pagerank_compat": _rank("dst") + " SELECT id, round(score, 9) AS score FROM ranks",
    "reading_guide": _rank("src") + f", {_IDX} SELECT module, round(sum(score), 7) AS score, count(*) AS n FROM ranks JOIN idx USING (id) GROUP BY module ORDER BY sum(score) DESC, module LIMIT 10",
    "condensation": f"{_E}, {_COND} SELECT src, dst FROM cond",
    "dependency_order": f"{_E}, {_LEVELS} SELECT id, level FROM lv UNION ALL SELECT DISTINCT id, 0 FROM components WHERE id NOT IN (SELECT id FROM lv)",
    "scc": f"""{_E}, c AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT c.a, e.dst FROM c JOIN edges e ON e.src = c.b)
        SELECT a AS id, min(b) AS scc FROM (SELECT x.a, x.b FROM c x JOIN c y ON y.a = x.b AND y.b = x.a) WHERE a IN (SELECT a FROM c WHERE a = b) GROUP BY a HAVING count(DISTINCT b) > 1""",
    "topological_levels": f"{_E}, {_LEVELS} SELECT id, level FROM lv",
    "degree_centrality": f"""{_E} SELECT a AS id, count(DISTINCT b) AS degree FROM (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst) GROUP BY a ORDER BY 2 DESC, 1 LIMIT 50""",
    "central_edges": f"""{_E}, t AS (SELECT a AS id FROM (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst) GROUP BY a ORDER BY count(DISTINCT b) DESC, 1 LIMIT 50)
        SELECT src, dst FROM edges WHERE src <> dst AND src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)""",
    "call_context": f"""{_E}, {_START.format(n=3)}, n AS (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM starts) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM starts))
        SELECT DISTINCT id, name, coalesce(array_to_string(parameters, ','), NULL) AS parameters FROM components WHERE id IN (SELECT id FROM n) AND id NOT IN (SELECT id FROM starts) ORDER BY id LIMIT 15""",
    "calls_deduplicated": "SELECT caller, callee, min(ord) AS ord FROM calls WHERE caller IS NOT NULL AND callee IS NOT NULL GROUP BY ALL",
    "doc_candidates": f"""{_E}, c AS (SELECT id, any_value(lower(trim(component_type))) AS t FROM components GROUP BY id),
        k AS (SELECT id FROM c WHERE t IN ('class', 'interface', 'struct') AND NOT regexp_matches(lower(id), 'error|exception|failed|invalid'))
        SELECT id FROM k WHERE (SELECT count(*) FROM k) < greatest(400, floor((SELECT count(*) FROM c) * 0.05)) OR id NOT IN (SELECT dst FROM edges WHERE src <> dst)""",
    "external_callees": f"""WITH c AS (SELECT DISTINCT id, {_LANG} AS lang FROM components), x AS (SELECT callee, lang FROM calls JOIN c ON c.id = caller WHERE callee IS NOT NULL
          UNION ALL SELECT * FROM (VALUES {', '.join(map(str, CALLEES))}) v(callee, lang)),
        std(lang, prefixes) AS (VALUES ('python', ['os', 'sys', 're', 'json', 'math', 'time', 'logging', 'pathlib', 'collections', 'itertools', 'functools', 'typing', 'datetime', 'subprocess', 'threading', 'asyncio', 'abc', 'io', 'copy', 'random', 'string', 'struct', 'hashlib', 'shutil']),
          ('java', ['java', 'javax', 'jdk', 'sun']), ('csharp', ['System', 'Microsoft']), ('go', ['fmt', 'errors', 'strings', 'strconv', 'os', 'io', 'time', 'sync', 'context', 'net', 'bytes', 'sort', 'log', 'math', 'bufio', 'json', 'http']),
          ('javascript', ['console', 'Math', 'JSON', 'Promise', 'Object', 'Array', 'String', 'Number', 'Date', 'Reflect', 'Symbol', 'process', 'Buffer', 'window', 'document']),
          ('typescript', ['console', 'Math', 'JSON', 'Promise', 'Object', 'Array', 'String', 'Number', 'Date', 'Reflect', 'Symbol', 'process', 'Buffer', 'window', 'document']))
        SELECT x.lang, CASE WHEN contains(callee, '::') AND NOT starts_with(callee, 'std::') THEN 'component' WHEN x.lang IN ('c', 'cpp') AND regexp_full_match(callee, '[A-Z][A-Z0-9_]{{2,}}') THEN 'macro'
          WHEN callee IN ('len', 'super') THEN 'builtin' WHEN contains(callee, '.') AND list_contains(prefixes, split_part(callee, '.', 1)) OR (x.lang IN ('c', 'cpp') AND starts_with(callee, 'std::')) THEN 'stdlib' ELSE 'unknown' END AS kind, count(*) AS n
        FROM x LEFT JOIN std ON std.lang = x.lang GROUP BY ALL""",
    "calls_resolved": f"WITH {_RESOLVED} SELECT caller, callee, target FROM resolved",
    "call_edges": f"""WITH {_RESOLVED}, named AS (SELECT name, arg_min(id, (ord, id)) AS id FROM components WHERE name IS NOT NULL GROUP BY name)
        SELECT DISTINCT caller AS src, coalesce(target, named.id) AS dst FROM resolved LEFT JOIN named ON name = callee WHERE coalesce(target, named.id) IS NOT NULL""",
    "impact_paths": f"""{_E}, {_REV}, near AS (SELECT id, min(depth) AS depth FROM r GROUP BY id), r2 AS (
          SELECT id, 0 AS depth, [id] AS path FROM starts UNION ALL
          SELECT id, depth, min(path) FROM (SELECT e.src AS id, r2.depth + 1 AS depth, list_append(r2.path, e.src) AS path FROM r2 JOIN edges e ON e.dst = r2.id JOIN near ON near.id = e.src AND near.depth = r2.depth + 1) GROUP BY id, depth)
        SELECT id, depth, array_to_string(path, ' > ') AS path FROM r2""",
    "affected_modules": f"""{_E}, {_reach("e.dst = r.id", "e.src", 1)}, f AS (SELECT DISTINCT id, repo_name, array_to_string(list_slice(string_split({q.clean_path('relative_path')}, '/'), 1, 2), '/') AS folder FROM components),
        hit AS (SELECT DISTINCT folder, repo_name FROM f JOIN r USING (id)) SELECT DISTINCT folder AS module, true AS direct FROM hit UNION ALL SELECT DISTINCT repo_name, false FROM hit WHERE repo_name NOT IN (SELECT folder FROM hit)""",
    "processing_order": f"""WITH f AS (SELECT DISTINCT repo_name, array_to_string(list_slice(string_split({q.clean_path('relative_path')}, '/'), 1, 2), '/') AS folder FROM components)
        SELECT DISTINCT repo_name AS module, CAST(NULL AS VARCHAR) AS parent, 0 AS depth FROM f UNION ALL SELECT DISTINCT folder, repo_name, 1 FROM f""",
}
