"""Scans, lookups and the smaller operators over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import scalar as S
from loomline.functions.ids import clean_path, id_path
from loomline.operators import changes, graph, lifecycle, links, resolve, retrieval, routes, sinks, summaries
from loomline.plans import samples
from loomline.plans import sqlbits as q
from loomline.plans.graphs import _modules
from loomline.sources import code, configs, files
from loomline.sources.tables import table

COMPOSE = "services:\n  web-{repo}:\n    build: ./web\n    ports: ['80{n}:80', '9000']\n    depends_on: [db]\n    environment: {{API_URL: 'http://api:1', MODE: x}}\n  api:\n    image: {repo}/api:{n}\n    depends_on:\n      db: {{condition: x}}\n      web-{repo}: {{}}\n  db:\n    image: pg\n    ports:\n      - target: 54{n}\n"


def _components(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "components")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return files.pages_of_documents(table(spark, d, "documents"))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The component of one id (the least of its repository)."""
    c = _components(spark, d)
    key = c.where("repo_name = 'indigo-ledger'").agg(F.min("id")).first()[0]
    return c.where(F.col("id") == F.lit(key)).select("id", "name", "start_line", "end_line").distinct()


def component_metas(spark: SparkSession, d: str) -> DataFrame:
    """All components without their texts."""
    return _components(spark, d).select("id", "name", "node_type", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), "language", "ord").distinct()


def components_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Components of all files, by semi-join."""
    f = _files(spark, d).select(F.col("relative_path").alias("p")).distinct()
    return _components(spark, d).withColumn("p", id_path("id")).join(f, "p", "left_semi").select("id").distinct()


def routes_of_role(spark: SparkSession, d: str) -> DataFrame:
    """Routes of one role, of the sample files."""
    return code.routes(samples.endpoint_files(spark)).where("role = 'client'").select("route_key", "component_id", "line_number")


def header_languages(spark: SparkSession, d: str) -> DataFrame:
    """Headers as C or C++ (Go files play the headers)."""
    f = _files(spark, d).select("repo_name", F.regexp_replace("relative_path", r"\.go$", ".h").alias("relative_path"), "file_text").dropDuplicates(["relative_path"])
    return code.header_language(f).select("relative_path", "language")


def file_view(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 lines of one file (the least path with a text)."""
    f = _files(spark, d).where("file_text is not null")
    path = f.agg(F.min("relative_path")).first()[0]
    return files.file_lines(f, path, 1, 40)


def git_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories among the top folders (the console repositories have a `.git`)."""
    f = _files(spark, d).select("relative_path").distinct()
    marks = f.where(F.col("relative_path").rlike("^[a-z]+-console/")).select(F.concat(F.substring_index("relative_path", "/", 1), F.lit("/.git/HEAD")).alias("relative_path"))
    return files.git_repositories(f.unionByName(marks))


def selected_files(spark: SparkSession, d: str) -> DataFrame:
    """files left by the default and some more patterns."""
    return files.select_files(_files(spark, d).select("relative_path").distinct(), include=["*.py", "*.go"], exclude=["tools/", "*_pb2.py"])


def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    """files that ignore rules match."""
    rules = [("", "*.min.js"), ("", "src/"), ("indigo-ledger", "lib/"), ("", "!*.go")]
    return files.ignored(_files(spark, d), rules).where("ignored").select("relative_path")


def infra_services(spark: SparkSession, d: str) -> DataFrame:
    """Services of a compose file for each repository, with its name and ports."""
    text = F.lit(COMPOSE.replace("{{", "{").replace("}}", "}"))
    text = F.replace(F.replace(text, F.lit("{repo}"), F.col("repo_name")), F.lit("{n}"), F.length("repo_name").cast("string"))
    repos = _files(spark, d).select("repo_name").distinct().select(F.concat("repo_name", F.lit("/docker-compose.yml")).alias("relative_path"), text.alias("file_text"), "repo_name")
    s = configs.compose_services(repos)
    return s.select("name", "source_file", "image", F.concat_ws(",", F.col("ports").cast("array<string>")).alias("ports"), F.concat_ws(",", "depends_on").alias("depends_on"))


def detected_services(spark: SparkSession, d: str) -> DataFrame:
    """Services of each repository's folders."""
    f = _files(spark, d).select(F.regexp_replace("relative_path", r"^[^/]*/", "").alias("relative_path"), "file_text", "repo_name")
    manifests = f.where("relative_path like 'app/%' or relative_path like 'cmd/%'").select(F.concat(F.substring_index("relative_path", "/", 1), F.lit("/pom.xml")).alias("relative_path"), "file_text", "repo_name")
    return configs.detect_services(f.unionByName(manifests))


def env_services(spark: SparkSession, d: str) -> DataFrame:
    """Services that configuration keys name."""
    e = _files(spark, d).select("repo_name").distinct().select(F.lit(".env").alias("source_file"), F.concat(F.upper(F.regexp_replace("repo_name", "-", "_")), F.lit("_SERVICE_URL")).alias("key"), F.concat(F.lit("http://"), "repo_name", F.lit(":80/x")).alias("value"))
    return configs.service_urls(e)


def edge_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What the most used component depends on and what depends on it."""
    e = graph.edges_of(_components(spark, d))
    one = graph.high_impact(e, 1, 1).select("id")
    return e.join(one.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst").unionByName(e.join(one.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))


def stem_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the module a page stem names (repositories and their folders as modules)."""
    stems = _components(spark, d).select(F.regexp_replace("repo_name", "-", "_").alias("stem")).distinct()
    folders = _modules(spark, d).withColumn("module", F.coalesce("parent", "module"))
    return resolve.module_components(folders, stems).select("stem", "component_id")


def source_references(spark: SparkSession, d: str) -> DataFrame:
    """Pages per source they refer to (wikilinks play the references)."""
    p = _pages(spark, d).select("doc_key", F.regexp_replace("text", r"\[\[([A-Za-z]+)\]\]", "[^src:$1:1-2]").alias("text"))
    return summaries.source_ref_counts(p)


def overview_references(spark: SparkSession, d: str) -> DataFrame:
    """Modules that overview pages link to; every page plays an overview, linked page names are the modules."""
    p = _pages(spark, d).select(F.concat("doc_key", F.lit("/overview.md")).alias("doc_key"), "text")
    return links.overview_refs(p, p.select(F.explode(S.wikilinks("text")).alias("module")).distinct())


def result_sources(spark: SparkSession, d: str) -> DataFrame:
    """Search results per source."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), "text", "source")
    found = retrieval.scan_search(docs, retrieval.query_terms("nested channel timeout", spark=spark))
    return retrieval.source_counts(found.join(docs.select("doc_key", "source"), "doc_key"))


def index_update(spark: SparkSession, d: str) -> DataFrame:
    """K7, K8: all terms' document frequencies after some pages changed and others went."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), "text", "doc_id")
    changed = docs.where("doc_id % 10 = 0").withColumn("text", F.lit("fresh words only"))
    posts, _ = retrieval.upsert_documents(retrieval.postings(docs), retrieval.doc_lengths(docs), changed, docs.where("doc_id % 10 = 1"))
    return retrieval.doc_frequencies(posts)


def routes_upserted(spark: SparkSession, d: str) -> DataFrame:
    """K2, K4: routes of the sample files after one file went and the routes of servers came again, at other lines."""
    r = code.routes(samples.endpoint_files(spark)).drop("extra")
    kept = changes.remove_routes(r, spark.createDataFrame([("./r\\m.go",)], "file string"))
    again = r.where("role = 'server'").withColumn("line_number", F.col("line_number") + 100)
    return changes.upsert_routes(kept, again, True).select("route_key", "component_id", "role", "line_number")


def operation_log(spark: SparkSession, d: str) -> DataFrame:
    """The log, newest day first (orders play the operations)."""
    e = table(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("operation"), F.col("o_orderkey").cast("string").alias("detail"))
    return sinks.operation_log(e).select(F.col("day").cast("string").alias("day"), "operation", "detail")


def repo_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys and page names of repositories."""
    r = _files(spark, d).select("repo_name").distinct()
    return r.select("repo_name", S.repo_hash(F.concat(F.lit("https://git/"), "repo_name")).alias("h"), S.module_doc_name("repo_name").alias("page"))


def json_columns(spark: SparkSession, d: str) -> DataFrame:
    """Lists written to JSON text and read back."""
    c = _components(spark, d).select("id", S.json_list(S.to_json_list("depends_on")).alias("l")).dropDuplicates(["id"])
    return c.select("id", F.size("l").alias("n"), F.array_join("l", ",").alias("listed"))


def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pages without their code blocks; the number of lines stays."""
    t = S.strip_code_blocks("text")
    return _pages(spark, d).select("doc_key", (F.length("text") - F.length(t)).alias("removed"), (F.size(F.split("text", "\n")) - F.size(F.split(t, "\n"))).alias("lines_lost")).where("removed > 0 or lines_lost <> 0")


def stale_dates(spark: SparkSession, d: str) -> DataFrame:
    """The day from which each page is stale."""
    return _pages(spark, d).select("doc_key", S.stale_date("updated_at").cast("string").alias("stale_after"))


def sinks_and_roots(spark: SparkSession, d: str) -> DataFrame:
    """components that depend on nothing, and those nothing depends on."""
    c, e = _components(spark, d), graph.edges_of(_components(spark, d))
    return graph.sinks(c, e).withColumn("kind", F.lit("sink")).unionByName(graph.roots(c, e).withColumn("kind", F.lit("root")))


def hits_added(spark: SparkSession, d: str) -> DataFrame:
    """Counters after a second batch of hits."""
    h = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file_path"), F.col("event_type").alias("query"), F.col("ts").alias("at"), "event_id")
    first, second = h.where("event_id % 2 = 0").drop("event_id"), h.where("event_id % 2 = 1").drop("event_id")
    return lifecycle.add_hits(lifecycle.retrieval_stats(first), second).select("file_path", "hit_count")


def url_paths(spark: SparkSession, d: str) -> DataFrame:
    """The paths of URLs, of bare hosts and of paths."""
    f, at = _files(spark, d).select("relative_path").distinct(), F.lit("https://host.example:8080")
    shapes = F.array(F.concat(at, F.lit("/"), F.col("relative_path"), F.lit("?a=1#b")), F.concat(at, F.lit("?"), F.col("relative_path")), F.concat(F.lit("/"), F.col("relative_path")))
    return f.select(F.explode(shapes).alias("url")).select("url", S.url_to_path("url").alias("path"))


def called_symbols(spark: SparkSession, d: str) -> DataFrame:
    """X11: called symbols without what surrounds their names."""
    c = table(spark, d, "calls").where("callee is not null").select("callee").distinct()
    shapes = F.array(F.concat(F.lit("  new "), F.col("callee"), F.lit("<K, V>(a, (b))")), F.concat(F.lit("*"), F.col("callee"), F.lit(" ")), F.concat(F.lit("&&"), F.col("callee"), F.lit("()")))
    return c.select("callee", F.explode(shapes).alias("s")).select("callee", S.normalize_symbol("s").alias("symbol"))


def service_names(spark: SparkSession, d: str) -> DataFrame:
    """The names of services by their folders."""
    folder = F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)
    return _files(spark, d).select(folder.alias("folder")).distinct().select("folder", S.service_name("folder").alias("name"))


def diagram_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The diagrams of pages, two of which stand at the end of each."""
    t = F.concat("text", F.lit("\n```mermaid\ngraph TD\n"), "doc_key", F.lit("\n```\n\n  ```mermaid\npie\n  ```\n"))
    return _pages(spark, d).select("doc_key", F.array_join(S.mermaid_blocks(t), "|").alias("blocks"))


def ontology_terms(spark: SparkSession, d: str) -> DataFrame:
    """The synonym groups of an ontology."""
    return files.ontology(spark, "synonyms:\n  cache: [buffer, store]\n  queue:\n    - channel\n    - dead letter\n  lone: single\n")


def route_listing(spark: SparkSession, d: str) -> DataFrame:
    """The routes of the sample files in the order of their table."""
    return routes.route_table(code.routes(samples.endpoint_files(spark))).select("repo_name", "role", "component_id", "route_key")


QUERIES = {f.__name__: f for f in (
    point_lookup, component_metas, components_of_files, routes_of_role, header_languages, file_view, git_repositories, selected_files, ignored_files, infra_services, detected_services,
    env_services, edge_lookup, stem_components, source_references, overview_references, result_sources, index_update, routes_upserted, operation_log, repo_hashes, json_columns,
    code_blocks, stale_dates, sinks_and_roots, hits_added, url_paths, called_symbols, service_names, diagram_blocks, ontology_terms, route_listing,
)}

_E = f"WITH {q.EDGES.strip()}"
SQL = {
    "point_lookup": "SELECT DISTINCT id, name, start_line, end_line FROM components WHERE id = (SELECT min(id) FROM components WHERE repo_name = 'indigo-ledger')",
    "component_metas": "SELECT DISTINCT id, name, node_type, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, language, ord FROM components",
    "components_of_files": "SELECT DISTINCT id FROM components WHERE split_part(id, '::', 1) IN (SELECT relative_path FROM source_files)",
    "routes_of_role": f"SELECT route_key, component_id, line_number FROM ({samples.SQL['sample_routes']}) WHERE role = 'client'",
    "routes_upserted": f"""WITH r AS ({samples.SQL['sample_routes']}) SELECT route_key, component_id, role, line_number FROM r WHERE role <> 'server' AND NOT starts_with(component_id, 'r/m.go')
        UNION ALL SELECT route_key, component_id, role, max(line_number) + 100 FROM r WHERE role = 'server' GROUP BY ALL""",
    "header_languages": """SELECT DISTINCT regexp_replace(relative_path, '\\.go$', '.h') AS relative_path, CASE WHEN regexp_matches(coalesce(file_text, ''), '(?m)^\\s*(?:class\\s+\\w+|namespace\\s+\\w+|template\\s*<|using\\s+namespace)|\\bstd::|\\b(?:public|private|protected):')
        THEN 'cpp' ELSE 'c' END AS language FROM source_files WHERE ends_with(relative_path, '.go')""",
    "selected_files": """SELECT DISTINCT relative_path FROM source_files WHERE regexp_matches(relative_path, '\\.(py|go)$') AND NOT ends_with(relative_path, '_pb2.py')
        AND len(list_intersect(string_split(relative_path, '/'), ['.git', '.github', '.vscode', '.idea', 'examples', '__pycache__', '.pytest_cache', '.tox', '.nox', '.mypy_cache', '.ruff_cache', '.hypothesis', 'node_modules',
          '.npm', '.yarn', '.pnpm-store', 'bower_components', 'target', 'dist', 'build', 'out', 'venv', '.venv', 'env', '.env', 'vendor', 'bin', 'obj', 'coverage', 'tools'])) = 0""",
    "ignored_files": """SELECT DISTINCT relative_path FROM source_files WHERE NOT ends_with(relative_path, '.go')
        AND (ends_with(relative_path, '.min.js') OR regexp_matches(relative_path, '(^|/)src/.') OR regexp_matches(relative_path, '^indigo-ledger/(.*/)?lib/.'))""",
    "detected_services": """WITH p AS (SELECT DISTINCT regexp_replace(relative_path, '^[^/]*/', '') AS p FROM source_files),
        s AS (SELECT DISTINCT split_part(p, '/', 1) AS f, 'manifest' AS source, 1 AS r FROM p WHERE split_part(p, '/', 1) IN ('app', 'cmd') AND contains(p, '/')
          UNION SELECT split_part(p, '/', 1) || '/' || split_part(p, '/', 2), 'convention', 2 FROM p WHERE split_part(p, '/', 1) IN ('services', 'apps', 'microservices', 'modules', 'packages') AND len(string_split(p, '/')) >= 3),
        b AS (SELECT f, arg_min(source, r) AS source FROM s WHERE len(list_intersect(string_split(f, '/'), ['node_modules', 'dist', 'build', 'target', 'coverage', 'vendor', 'test', 'tests', 'testing', 'e2e', 'docs', 'doc', 'scripts', 'migrations', 'fixtures', 'mocks'])) = 0 GROUP BY f)
        SELECT split_part(f, '/', -1) AS name, f AS relative_path, source FROM b WHERE NOT EXISTS (SELECT 1 FROM b x WHERE starts_with(b.f, x.f || '/'))""",
    "result_sources": f"""WITH {q.ranked('sc', f"SELECT CAST(doc_id AS VARCHAR) AS doc_key, {q.tokens('text')} AS toks FROM documents", "SELECT unnest(['nested', 'channel', 'timeout']) AS token, 1 AS times")}
        SELECT d.source, count(*) AS n FROM sc JOIN documents d ON CAST(d.doc_id AS VARCHAR) = sc.doc_key GROUP BY d.source""",
    "code_blocks": f"""WITH {q.PAGES}, l AS (SELECT doc_key, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_key, string_split(text, chr(10)) AS ls FROM pages)),
        c AS (SELECT doc_key, line, fence = 1 OR sum(fence) OVER (PARTITION BY doc_key ORDER BY no) % 2 = 1 AS fenced FROM (SELECT *, CASE WHEN regexp_matches(line, '^[ \\t]*```') THEN 1 ELSE 0 END AS fence FROM l))
        SELECT doc_key, sum(length(line)) AS removed, 0 AS lines_lost FROM c WHERE fenced GROUP BY doc_key HAVING sum(length(line)) > 0""",
    "file_view": """WITH f AS (SELECT file_text AS t FROM source_files WHERE relative_path = (SELECT min(relative_path) FROM source_files WHERE file_text IS NOT NULL) LIMIT 1),
        l AS (SELECT unnest(list_slice(string_split(t, chr(10)), 1, 40)) AS line, generate_subscripts(list_slice(string_split(t, chr(10)), 1, 40), 1) AS line_no FROM f) SELECT line_no, line FROM l""",
    "git_repositories": "SELECT DISTINCT split_part(relative_path, '/', 1) AS name FROM source_files WHERE regexp_matches(relative_path, '^[a-z]+-console/')",
    "infra_services": """WITH r AS (SELECT DISTINCT repo_name AS r, length(repo_name) AS n, repo_name || '/docker-compose.yml' AS source_file FROM source_files)
        SELECT 'web-' || r AS name, source_file, NULL AS image, '80' || n || ',9000' AS ports, 'db' AS depends_on FROM r UNION ALL SELECT 'api', source_file, r || '/api:' || n, '', 'db,web-' || r FROM r UNION ALL SELECT 'db', source_file, 'pg', '54' || n, '' FROM r""",
    "env_services": """SELECT DISTINCT '.env' AS source_file, upper(replace(repo_name, '-', '_')) || '_SERVICE_URL' AS key, repo_name AS service, repo_name AS host FROM source_files""",
    "edge_lookup": f"{_E}, o AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM o) UNION ALL SELECT src, dst FROM edges WHERE dst IN (SELECT id FROM o)",
    "stem_components": "SELECT DISTINCT replace(repo_name, '-', '_') AS stem, id AS component_id FROM components",
    "source_references": f"WITH {q.PAGES} SELECT name, count(*) AS n_pages FROM (SELECT DISTINCT doc_key, unnest(regexp_extract_all(text, '\\[\\[([A-Za-z]+)\\]\\]', 1)) AS name FROM pages) GROUP BY name",
    "overview_references": f"""WITH {q.PAGES}, w AS (SELECT DISTINCT doc_key, lower(m) AS k FROM (SELECT doc_key, unnest({q.wikilinks('text')}) AS m FROM pages)),
        h AS (SELECT DISTINCT doc_key, {q.stem('m')} AS k FROM (SELECT doc_key, unnest({q.hrefs('text')}) AS m FROM pages)),
        n AS (SELECT DISTINCT m AS module FROM (SELECT unnest({q.wikilinks('text')}) AS m FROM pages))
        SELECT DISTINCT doc_key || '/overview.md' AS doc_key, module FROM (SELECT * FROM w UNION SELECT * FROM h) x JOIN n ON lower(n.module) = x.k""",
    "index_update": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'fresh words only' ELSE text END AS t FROM documents WHERE doc_id % 10 <> 1),
        b AS (SELECT doc_id, CASE WHEN {q.fm_text('t')} = '' THEN t ELSE concat_ws(chr(10), {q.fm_value('t', 'title')}, {q.fm_value('t', 'description')}, {q.fm_value('t', 'severity')}, {q.without_fm('t')}) END AS x FROM d)
        SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({q.tokens('x')}) AS token FROM b) GROUP BY token""",
    "operation_log": "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS operation, CAST(o_orderkey AS VARCHAR) AS detail FROM orders",
    "repo_hashes": "SELECT DISTINCT repo_name, left(sha256('https://git/' || repo_name), 16) AS h, lower(repo_name) || '.md' AS page FROM source_files",
    "json_columns": "SELECT DISTINCT id, coalesce(len(depends_on), 0) AS n, coalesce(array_to_string(depends_on, ','), '') AS listed FROM components",
    "stale_dates": f"WITH {q.PAGES} SELECT doc_key, CAST(CAST(updated_at AS DATE) + 90 AS VARCHAR) AS stale_after FROM pages",
    "sinks_and_roots": f"{_E} SELECT DISTINCT id, 'sink' AS kind FROM components WHERE id NOT IN (SELECT src FROM edges) UNION ALL SELECT DISTINCT id, 'root' FROM components WHERE id NOT IN (SELECT dst FROM edges)",
    "url_paths": """WITH f AS (SELECT DISTINCT relative_path AS r FROM source_files) SELECT 'https://host.example:8080/' || r || '?a=1#b' AS url, '/' || r AS path FROM f
        UNION ALL SELECT 'https://host.example:8080?' || r, '/' FROM f UNION ALL SELECT '/' || r, '/' || r FROM f""",
    "called_symbols": "WITH c AS (SELECT DISTINCT callee FROM calls WHERE callee IS NOT NULL) SELECT callee, trim(callee) AS symbol FROM c, range(3)",
    "service_names": "SELECT DISTINCT regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS folder, split_part(relative_path, '/', -2) AS name FROM source_files",
    "diagram_blocks": f"""WITH {q.PAGES} SELECT doc_key, array_to_string(list_concat(regexp_extract_all(text, '(?ms)^[ \\t]*```mermaid[ \\t]*\\r?\\n(.*?)^[ \\t]*```', 1), ['graph TD' || chr(10) || doc_key || chr(10), 'pie' || chr(10)]), '|') AS blocks FROM pages""",
    "ontology_terms": "SELECT * FROM (VALUES ('cache', 'cache'), ('cache', 'buffer'), ('cache', 'store'), ('queue', 'queue'), ('queue', 'channel'), ('queue', 'dead letter'), ('lone', 'lone'), ('lone', 'single')) t(group_id, member)",
    "route_listing": f"SELECT 'r' AS repo_name, role, component_id, route_key FROM ({samples.SQL['sample_routes']})",
    "hits_added": "SELECT CAST(user_id AS VARCHAR) AS file_path, count(*) AS hit_count FROM events GROUP BY 1",
}
