"""Cross-service queries. Routes are the endpoints and links that documents mention: a wiki or design page serves the
endpoints in it, any other source calls them (placeholders filled in); broken-link lines of logs are messages from one
page's topic to another's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import scalar as S
from loomline.operators import routes as r
from loomline.plans import sqlbits as q
from loomline.sources import code
from loomline.sources.tables import table

ENDPOINT = r"\b((?:GET|POST|PUT|DELETE|PATCH) /[A-Za-z0-9/_.-]+(?:\{[^}]+\})?)"


def _routes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    server = F.col("source").startswith("wiki-") | F.col("source").isin("design-review", "raw-sources")
    e = docs.select("doc_id", "source", server.alias("server"), F.explode(F.regexp_extract_all("text", F.lit(ENDPOINT), 1)).alias("e"))
    verb, raw = F.substring_index("e", " ", 1), F.substring_index("e", " ", -1)
    path = F.when(F.col("server") | (F.pmod("doc_id", F.lit(2)) == 0), S.canonicalize_path(raw)).otherwise(F.regexp_replace(raw, r"\{[^}]+\}", "42"))
    cid = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    http = e.select(
        S.route_key(verb, path).alias("route_key"), F.lit("http").alias("protocol"), verb.alias("method"), S.canonicalize_path(path).alias("path"),
        F.when(F.col("server"), "server").otherwise("client").alias("role"), cid.alias("component_id"), F.col("source").alias("repo_name"),
    )
    m = docs.select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(r"broken link (\w+\.md -> \w+\.md)"), 1)).alias("m"))
    none = F.lit(None).cast("string")
    side = lambda k, role: m.select(
        S.mq_route_key(F.lit("Kafka"), F.split("m", " -> ")[k]).alias("route_key"), F.lit("mq").alias("protocol"), none.alias("method"), F.split("m", " -> ")[k].alias("path"),
        F.lit(role).alias("role"), cid.alias("component_id"), F.col("source").alias("repo_name"),
    )
    return http.unionByName(side(0, "client")).unionByName(side(1, "server"))


def route_rows(spark: SparkSession, d: str) -> DataFrame:
    """Routes with their keys."""
    return _routes(spark, d).distinct()


def route_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches."""
    return r.match_exact(_routes(spark, d)).select("client_repo", "client_component", "server_repo", "server_component", "route_key", "method")


def route_classes(spark: SparkSession, d: str) -> DataFrame:
    """Links per pair of sources and key, counted without being made."""
    rows = _routes(spark, d)
    return r.link_counts(rows).unionByName(r.link_counts(rows, "mq"))


def route_template(spark: SparkSession, d: str) -> DataFrame:
    """Template matches."""
    return r.match_templates(_routes(spark, d)).select("client_repo", "client_component", "server_repo", "server_component", "route_key", "method")


def route_queues(spark: SparkSession, d: str) -> DataFrame:
    """Producers and consumers per pair of sources and topic."""
    return r.link_counts(_routes(spark, d), "mq").select("client_repo", "server_repo", "route_key", F.col("n_links").alias("n"))


def route_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Routes in no link, by key."""
    return r.unmatched_classes(_routes(spark, d)).groupBy("protocol", "role", "route_key").agg(F.sum("n").alias("n"))


def service_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A10: links per pair of sources with three sample keys."""
    p = r.service_pairs(r.link_counts(_routes(spark, d)))
    return p.select("client_repo", "server_repo", "n_calls", "n_keys", F.array_join("sample_keys", ",").alias("sample_keys"))


def edge_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the service chart's edges."""
    return r.edge_labels(r.link_counts(_routes(spark, d)))


def protocol_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Links per protocol."""
    return r.protocol_histogram(route_classes(spark, d))


def links_filtered(spark: SparkSession, d: str) -> DataFrame:
    """exact links of one service, method and path prefix."""
    x = r.links_of_path(r.links_of_method(r.links_of_service(r.match_exact(_routes(spark, d)), "WIKI"), "post"), "/api")
    return x.groupBy("client_repo", "server_repo").agg(F.count(F.lit(1)).alias("n"))


def route_trace(spark: SparkSession, d: str) -> DataFrame:
    """F8: everything about one key, the least that is in a link."""
    rows = _routes(spark, d)
    key = r.link_counts(rows).agg(F.min("route_key")).first()[0]
    return r.trace_route(r.match_exact(rows.where(F.col("route_key") == F.lit(key))), rows, key)


def links_merged(spark: SparkSession, d: str) -> DataFrame:
    """Local links and those of a trace (here the template matches) that are new."""
    rows = _routes(spark, d)
    merged = r.merge_links(r.match_exact(rows), r.match_templates(rows).drop("client_path"))
    return merged.groupBy("client_repo", "server_repo", "route_key", "confidence").agg(F.count(F.lit(1)).alias("n"))


def code_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes read from the source files."""
    return code.routes(table(spark, d, "source_files")).select("route_key", "protocol", "role", "component_id", "repo_name", "line_number", "framework")


QUERIES = {f.__name__: f for f in (
    route_rows, route_exact, route_classes, route_template, route_queues, route_unmatched, service_pairs, edge_labels, protocol_histogram, links_filtered, route_trace, links_merged, code_routes,
)}

_RAW = r"\b((?:GET|POST|PUT|DELETE|PATCH) /[A-Za-z0-9/_.-]+(?:\{[^}]+\})?)"
_R = f"""
WITH ep AS (SELECT doc_id, source, starts_with(source, 'wiki-') OR source IN ('design-review', 'raw-sources') AS server,
              unnest(regexp_extract_all(text, '{_RAW}', 1)) AS e FROM documents WHERE text IS NOT NULL),
e2 AS (SELECT *, split_part(e, ' ', 1) AS verb, split_part(e, ' ', 2) AS raw FROM ep),
e3 AS (SELECT *, CASE WHEN server OR doc_id % 2 = 0 THEN {q.canonical('raw')} ELSE regexp_replace(raw, '\\{{[^}}]+\\}}', '42', 'g') END AS p0 FROM e2),
e4 AS (SELECT *, {q.canonical('p0')} AS p FROM e3),
mq AS (SELECT doc_id, source, unnest(regexp_extract_all(text, 'broken link (\\w+\\.md -> \\w+\\.md)', 1)) AS m FROM documents WHERE text IS NOT NULL),
routes AS (
  SELECT '__route__' || verb || '__' || p AS route_key, 'http' AS protocol, verb AS method, p AS path, CASE WHEN server THEN 'server' ELSE 'client' END AS role, 'doc-' || doc_id AS component_id, source AS repo_name FROM e4
  UNION ALL SELECT '__mq__kafka__' || split_part(m, ' -> ', 1), 'mq', NULL, split_part(m, ' -> ', 1), 'client', 'doc-' || doc_id, source FROM mq
  UNION ALL SELECT '__mq__kafka__' || split_part(m, ' -> ', 2), 'mq', NULL, split_part(m, ' -> ', 2), 'server', 'doc-' || doc_id, source FROM mq
), c AS (SELECT * FROM routes WHERE role = 'client'), s AS (SELECT * FROM routes WHERE role = 'server'),
x AS (SELECT DISTINCT c.repo_name AS client_repo, c.component_id AS client_component, s.repo_name AS server_repo, s.component_id AS server_component, c.route_key, c.method
  FROM c JOIN s USING (route_key) WHERE c.protocol = 'http' AND s.protocol = 'http' AND c.repo_name <> s.repo_name),
t AS (SELECT DISTINCT c.repo_name AS client_repo, c.component_id AS client_component, s.repo_name AS server_repo, s.component_id AS server_component, s.route_key, c.route_key AS own, c.method
  FROM c JOIN s ON c.protocol = 'http' AND s.protocol = 'http' AND c.repo_name <> s.repo_name AND s.method = c.method
   AND regexp_full_match(c.path, replace(replace(s.path, '.', '\\.'), '{{}}', '[^/]+')) WHERE c.route_key NOT IN (SELECT route_key FROM s WHERE protocol = 'http')),
m AS (SELECT c.repo_name AS client_repo, s.repo_name AS server_repo, c.route_key FROM c JOIN s USING (route_key) WHERE c.protocol = 'mq' AND s.protocol = 'mq' AND c.repo_name <> s.repo_name)
"""
_N = "SELECT client_repo, server_repo, route_key, count(*) AS n FROM {} GROUP BY ALL"
_PAIRS = """SELECT client_repo, server_repo, sum(n) AS n_calls, count(*) AS n_keys, string_agg(CASE WHEN k <= 3 THEN route_key END, ',' ORDER BY route_key) AS sample_keys
  FROM (SELECT *, row_number() OVER (PARTITION BY client_repo, server_repo ORDER BY route_key) AS k FROM (SELECT client_repo, server_repo, route_key, count(*) AS n FROM x GROUP BY ALL)) GROUP BY ALL"""
SQL = {
    "route_rows": f"{_R} SELECT DISTINCT * FROM routes",
    "route_exact": f"{_R} SELECT client_repo, client_component, server_repo, server_component, route_key, method FROM x",
    "route_classes": f"{_R} SELECT client_repo, server_repo, route_key, 'http' AS protocol, count(*) AS n_links FROM x GROUP BY ALL UNION ALL SELECT client_repo, server_repo, route_key, 'mq', count(*) FROM m GROUP BY ALL",
    "route_template": f"{_R} SELECT DISTINCT client_repo, client_component, server_repo, server_component, route_key, method FROM t",
    "links_merged": f"""{_R} SELECT client_repo, server_repo, route_key, 1.0 AS confidence, count(*) AS n FROM x GROUP BY ALL
        UNION ALL SELECT DISTINCT client_repo, server_repo, route_key, 0.8, 1 FROM t WHERE (client_repo, server_repo, route_key) NOT IN (SELECT (client_repo, server_repo, route_key) FROM x)""",
    "route_trace": f"""{_R}, k AS (SELECT min(route_key) AS k FROM x) SELECT 'link' AS kind, client_repo AS repo_name, client_component AS component_id, server_repo AS other_repo, server_component AS other_component FROM x JOIN k ON route_key = k
        UNION ALL SELECT role, repo_name, component_id, NULL, NULL FROM routes JOIN k ON route_key = k""",
    "route_queues": _R + _N.format("m"),
    "route_unmatched": f"{_R} SELECT protocol, role, route_key, count(*) AS n FROM routes WHERE route_key NOT IN (SELECT route_key FROM x UNION SELECT route_key FROM t UNION SELECT own FROM t UNION SELECT route_key FROM m) GROUP BY ALL",
    "service_pairs": _R + _PAIRS,
    "edge_labels": f"{_R} SELECT client_repo, server_repo, replace(sample_keys, ',', ', ') || CASE WHEN n_keys > 3 THEN ' +' || (n_keys - 3) ELSE '' END AS label FROM ({_PAIRS})",
    "protocol_histogram": f"{_R} SELECT 'http' AS protocol, count(*) AS n_links FROM x HAVING count(*) > 0 UNION ALL SELECT 'mq', count(*) FROM m HAVING count(*) > 0",
    "links_filtered": f"{_R} SELECT client_repo, server_repo, count(*) AS n FROM x WHERE (contains(client_repo, 'wiki') OR contains(server_repo, 'wiki')) AND method = 'POST' AND contains(route_key, '__/api') GROUP BY ALL",
}
