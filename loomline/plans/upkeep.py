"""Queries of change detection, summaries, lifecycles, scalars and lint, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import scalar as S
from loomline.functions.ids import clean_path
from loomline.operators import changes, graph, lifecycle, lint, resolve, sinks, summaries
from loomline.plans import lintsql, samples
from loomline.plans import sqlbits as q
from loomline.plans.graphs import _modules
from loomline.sources import code, files
from loomline.sources.tables import table

MODS = "CAST(ord AS BIGINT)"


def _components(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "components")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _two_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The components, and a second state in which every 7th changed, every 11th went and copies of every 13th came."""
    old = _components(spark, d).select("id", "content_hash", "ord").dropDuplicates(["id"])
    o = F.col("ord")
    new = old.where(o % 11 != 0).select("id", F.when(o % 7 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"))
    more = old.where(o % 13 == 0).select(F.concat("id", F.lit("_new")).alias("id"), "content_hash")
    return old.drop("ord"), new.unionByName(more)


# changes


def component_changes(spark: SparkSession, d: str) -> DataFrame:
    """Added, modified and deleted components."""
    return changes.component_changes(*_two_states(spark, d))


def component_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K1, U4: the merged state, new rows in place of old ones."""
    return changes.upsert(*_two_states(spark, d), ["id"])


def symbols_inserted(spark: SparkSession, d: str) -> DataFrame:
    """K6: old rows stay, only new keys come."""
    return changes.insert_missing(*_two_states(spark, d), ["id"])


def unchanged_components(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the first state that the second lacks."""
    old, new = _two_states(spark, d)
    return changes.minus(old.select("id"), new, ["id"])


def file_changes(spark: SparkSession, d: str) -> DataFrame:
    """New, vanished and changed files by fingerprint."""
    old = _files(spark, d).select(F.col("relative_path").alias("file_path"), "mtime", "size", "content_hash", "file_id").dropDuplicates(["file_path"])
    i = F.col("file_id")
    new = old.where(i % 9 != 0).select(
        F.when(i % 8 == 0, F.concat("file_path", F.lit(".moved"))).otherwise(F.col("file_path")).alias("file_path"),
        (F.col("mtime") + F.when(i % 4 == 1, 0.5).when(i % 4 == 2, 1.5).otherwise(0.0)).alias("mtime"),
        F.when(i % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(i % 5 == 0, F.concat("content_hash", F.lit("x"))).when(i % 3 != 0, F.col("content_hash")).alias("content_hash"),
    )
    return changes.file_changes(old.drop("file_id"), new)


def listed_changes(spark: SparkSession, d: str) -> DataFrame:
    """The distinct files of several lists below one repository."""
    f = _files(spark, d).select(F.col("relative_path").alias("file"))
    return changes.listed_changes(f, f.select(F.concat(F.lit("./"), "file").alias("file")), subpath="indigo-ledger")


def modified_since(spark: SparkSession, d: str) -> DataFrame:
    """Files changed since a time."""
    return changes.modified_since(_files(spark, d).select(F.col("relative_path").alias("file_path"), "mtime"), 1740000000.0)


def latest_documents(spark: SparkSession, d: str) -> DataFrame:
    """K5, K8: the latest row of each document key."""
    rows = _documents(spark, d).where("doc_key is not null").select("doc_key", "doc_id", "updated_at", "n_chars")
    return changes.latest(rows, ["doc_key"], ["updated_at", "doc_id"]).select("doc_key", "doc_id")


def files_removed(spark: SparkSession, d: str) -> DataFrame:
    """K3: components left after some files went, given by parts of their paths."""
    gone = _files(spark, d).where("file_id % 6 = 0").select(F.regexp_replace("relative_path", r"^[^/]*/", "").alias("file"))
    kept, _ = changes.remove_files(_components(spark, d), graph.edges_of(_components(spark, d)), gone)
    return kept.select("id").distinct()


def edges_after_removal(spark: SparkSession, d: str) -> DataFrame:
    """K3: edges left after some files went."""
    gone = _files(spark, d).where("file_id % 6 = 0").select(F.regexp_replace("relative_path", r"^[^/]*/", "").alias("file"))
    return changes.remove_files(_components(spark, d), graph.edges_of(_components(spark, d)), gone)[1]


def suffix_matches(spark: SparkSession, d: str) -> DataFrame:
    """Components of all files, given by a part of their path and with the workspace before it."""
    f = _files(spark, d)
    short = f.select(F.regexp_replace("relative_path", r"^[^/]*/", "").alias("file"))
    return resolve.suffix_match(_components(spark, d), short.unionByName(f.select(F.col("file_path").alias("file"))))


def service_labels(spark: SparkSession, d: str) -> DataFrame:
    """The longest service folder of each file; services are all folders named src, lib or pkg and the repositories."""
    f = _files(spark, d).select(F.col("relative_path").alias("file"))
    p = F.split("file", "/")
    s = f.where(F.get(p, 1).isin("src", "lib", "pkg")).select(F.array_join(F.slice(p, 1, 2), "/").alias("relative_path")).distinct()
    s = s.unionByName(f.where(F.col("file").startswith("i")).select(F.get(p, 0).alias("relative_path")).distinct())
    return resolve.service_labels(f, s.withColumn("name", F.col("relative_path")))


def nested_services(spark: SparkSession, d: str) -> DataFrame:
    """Folders that lie in no other listed folder."""
    p = F.split("relative_path", "/")
    s = _files(spark, d).select(F.explode(F.array(F.when(F.length("relative_path") % 2 == 0, F.array_join(F.slice(p, 1, 2), "/")), F.array_join(F.slice(p, 1, 3), "/"))).alias("relative_path"))
    return changes.without_nested(s.where("relative_path is not null").distinct().withColumn("name", F.col("relative_path")))


# summaries


def component_count(spark: SparkSession, d: str) -> DataFrame:
    """A1."""
    return summaries.component_count(_components(spark, d))


def component_list(spark: SparkSession, d: str) -> DataFrame:
    """The methods of one repository."""
    return summaries.list_components(_components(spark, d), "indigo-ledger/", "method")


def file_summary(spark: SparkSession, d: str) -> DataFrame:
    """A2: components per file, by type, with the class names."""
    s = summaries.file_summary(_components(spark, d))
    entries = F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("file", "n", F.array_join(entries, ",").alias("types"), F.array_join("classes", ",").alias("classes"))


def language_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files per language as written."""
    return summaries.language_counts(_files(spark, d))


def extension_languages(spark: SparkSession, d: str) -> DataFrame:
    """Code files by the language of their extension."""
    return code.code_files(_files(spark, d)).groupBy("language", "supported").agg(F.count(F.lit(1)).alias("n"))


def file_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files and kilobytes."""
    return summaries.file_totals(_files(spark, d))


def directory_listing(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a folder."""
    return files.directory_listing(_files(spark, d), "indigo-ledger")


def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    """The share of components in modules; here those with parameters count as listed."""
    c = _components(spark, d)
    return summaries.coverage(c, c.where("size(parameters) > 0").select(F.col("id").alias("component_id")))


def coverage_low(spark: SparkSession, d: str) -> DataFrame:
    """Repositories in which less than half of the components claim a docstring."""
    return summaries.coverage_by_group(_components(spark, d), "repo_name", F.coalesce("has_docstring", F.lit(False)))


def naming_convention(spark: SparkSession, d: str) -> DataFrame:
    """The commonest naming style of functions."""
    rows = _components(spark, d).dropDuplicates(["id"]).select(F.substring_index("name", ".", -1).alias("name"))
    return summaries.naming_convention(rows)


def tree_totals(spark: SparkSession, d: str) -> DataFrame:
    """Modules and entries of the module tree."""
    return summaries.tree_totals(_modules(spark, d))


def complex_modules(spark: SparkSession, d: str) -> DataFrame:
    """modules that span several files."""
    return summaries.complex_modules(_modules(spark, d), _components(spark, d))


def leaf_listing(spark: SparkSession, d: str) -> DataFrame:
    """What is documented, per file, with an estimate of tokens."""
    c = _components(spark, d)
    rows = summaries.leaf_listing(graph.doc_candidates(c, graph.edges_of(c)), c)
    return rows.select("file", "n", "tokens")


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """components that look like entry points, those of the sample files among them."""
    cols = ["id", "name", "relative_path", "component_type", "node_type"]
    more = samples.parsed(spark).withColumn("node_type", F.col("component_type"))
    return summaries.entry_points(_components(spark, d).select(*cols).unionByName(more.select(*cols)))


def symbol_map(spark: SparkSession, d: str) -> DataFrame:
    """Class names, the first of their files and how many there are."""
    return resolve.symbol_files(_components(spark, d))


def symbol_links(spark: SparkSession, d: str) -> DataFrame:
    """Class names in code spans of pages."""
    pages = files.pages_of_documents(_documents(spark, d))
    c = _components(spark, d).withColumn("name", F.substring_index("name", ".", -1)).withColumn("component_type", F.lit("class"))
    return resolve.symbol_links(pages, resolve.symbol_files(c))


def module_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that pages mention, the first five of each."""
    pages = files.pages_of_documents(_documents(spark, d))
    m = _components(spark, d).select(F.col("repo_name").alias("module")).distinct().withColumn("preorder", F.lit(0))
    return resolve.mentioned_modules(pages, m).select("doc_key", "module")


def routing_classes(spark: SparkSession, d: str) -> DataFrame:
    """components by routing class, and parts whose names, types and sizes play names with the suffixes and annotations."""
    c = _components(spark, d).dropDuplicates(["id"]).select("name", "relative_path", "source_code")
    size, first = F.col("p_size"), lambda x: F.lower(F.substring_index(x, " ", 1))
    ends = F.when(size % 4 == 0, "Dto").when(size % 4 == 1, "Client").when(size % 4 == 2, "Service").otherwise("")
    parts = table(spark, d, "part").select(F.concat(first("p_name"), ends).alias("name"), F.concat(F.lit("src/"), first("p_type"), F.lit("/")).alias("relative_path"), F.when(size % 5 == 0, "@Bean").alias("source_code"))
    return c.unionByName(parts).groupBy(resolve.routing_class("name", "relative_path", "source_code").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def component_sources(spark: SparkSession, d: str) -> DataFrame:
    """The lines of components in their files."""
    s = code.component_source(_components(spark, d), _files(spark, d))
    return s.select("id", F.md5("source").alias("source_md5"))


def parsed_components(spark: SparkSession, d: str) -> DataFrame:
    """Components read from the source files, by language and type."""
    c = code.components(_files(spark, d))
    return c.groupBy("language", "component_type").agg(F.count(F.lit(1)).alias("n"))


def parsed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls read from the source files, by kind."""
    return code.calls(_files(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def graph_json(spark: SparkSession, d: str) -> DataFrame:
    """Components as JSON with what they depend on."""
    c = _components(spark, d)
    return sinks.graph_json(c, graph.edges_of(c))


def chart_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the network chart."""
    c = _components(spark, d)
    return sinks.chart_elements(c, graph.edges_of(c))


def index_page(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the index."""
    return sinks.index_page(files.pages_of_documents(_documents(spark, d)))


# scalars


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of components by their source."""
    return _components(spark, d).dropDuplicates(["id"]).where("source_code is not null").select("id", S.content_hash("source_code").alias("h"))


def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of files."""
    return _files(spark, d).dropDuplicates(["relative_path"]).where("file_text is not null").select("relative_path", S.file_hash("file_text").alias("h"))


def duplicate_sources(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand in several documents."""
    h = _documents(spark, d).where("text is not null").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"))
    return h.where("n > 1")


def minified_files(spark: SparkSession, d: str) -> DataFrame:
    """files that the size and line test calls minified."""
    return _files(spark, d).dropDuplicates(["relative_path"]).where(S.is_minified("file_text")).select("relative_path")


def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Titles as URL parts."""
    return _documents(spark, d).where("title is not null").select("title").distinct().select("title", S.slugify("title").alias("slug"))


def note_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of documents."""
    t = S.extract_tags("title", "text", F.lit("note"))
    return _documents(spark, d).where("text is not null").select("doc_id", F.array_join(t, ",").alias("tags"))


def packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages of components and how many they hold."""
    c = _components(spark, d).dropDuplicates(["id"])
    return c.groupBy(S.package_of("qualified_name", "node_type").alias("package")).agg(F.count(F.lit(1)).alias("n"))


def clean_paths(spark: SparkSession, d: str) -> DataFrame:
    """Component paths in one notation, with their depth."""
    p = clean_path("relative_path")
    return _components(spark, d).select("id", p.alias("path"), S.page_depth(p).alias("depth")).distinct()


# lifecycle


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("file_path"), F.col("event_type").alias("query"), F.col("ts").alias("at"))


def retrieval_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counters of hits."""
    return lifecycle.retrieval_stats(_hits(spark, d)).select("file_path", "hit_count", F.col("first_hit").cast("string").alias("first_hit"), F.col("last_hit").cast("string").alias("last_hit"))


def stats_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The fifty files with most hits."""
    return lifecycle.rank_stats(lifecycle.retrieval_stats(_hits(spark, d)), least=2).select("file_path", "hit_count")


def hit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Distinct queries and the share of customers hit."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file_path"))
    return lifecycle.hit_summary(_hits(spark, d), c)


def zero_hits(spark: SparkSession, d: str) -> DataFrame:
    """Customers without events."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file_path"))
    return lifecycle.zero_hits(c, lifecycle.retrieval_stats(_hits(spark, d)))


def issue_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Issues by their stable id."""
    flags = table(spark, d, "events").select(F.col("event_type").alias("issue_type"), F.col("user_id").cast("string").alias("page_path"), F.round("value", 0).cast("string").alias("description"), F.col("ts").alias("at"))
    return lifecycle.flag_issues(flags).select("issue_id", "issue_type", "page_path", "occurrences")


def sessions_2h(spark: SparkSession, d: str) -> DataFrame:
    """T4: sessions of users with a gap of two hours."""
    return lifecycle.sessions(table(spark, d, "events")).select("user_id", F.col("started").cast("string").alias("started"), "n_events")


def sessions_kept(spark: SparkSession, d: str) -> DataFrame:
    """T5: the ten users seen last."""
    return lifecycle.kept_sessions(table(spark, d, "events")).select("user_id", F.col("last_access").cast("string").alias("last_access"))


def sessions_expired(spark: SparkSession, d: str) -> DataFrame:
    """Events older than ten days at a time."""
    return lifecycle.expired(table(spark, d, "events"), "ts", "2024-01-31 00:00:00", 10).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def edit_history(spark: SparkSession, d: str) -> DataFrame:
    """The last three events of each user."""
    return lifecycle.history(table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at")), 3, "user_id").select("user_id", "event_id")


def note_states(spark: SparkSession, d: str) -> DataFrame:
    """The present state of notes; orders play the notes, their status words the states."""
    e = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("note"), F.struct("o_orderdate", "o_orderkey").alias("at"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "candidate").otherwise("rejected").alias("status"),
        F.col("o_orderpriority").alias("by"), F.lit(None).cast("string").alias("reason"),
    )
    return lifecycle.note_states(e).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("verified_by")).alias("confirmations"))


def sources_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Sources by content, some retracted."""
    a = _documents(spark, d).where("text is not null").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("content_hash"), F.col("updated_at").alias("at"))
    gone = a.where("cast(name as bigint) % 10 = 0").select("name")
    return lifecycle.ingest_sources(a, gone).select("name", "status")


def batch_status(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each item of a batch."""
    b = _documents(spark, d).select(F.col("doc_id").alias("item"), F.when(F.col("source").startswith("notes-"), "note").when(F.col("source") == "raw-sources", "source").alias("kind"), "title", F.col("text").alias("content"))
    return lifecycle.batch_ingest(b).groupBy("kind", "status", "error").agg(F.count(F.lit(1)).alias("n"))


def migrated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the front matter they lacked."""
    return lifecycle.migrate(files.pages_of_documents(_documents(spark, d)), "2025-06-01").select("doc_key", F.md5("text").alias("text_md5"), "changed")


# lint


def _wiki(spark: SparkSession, d: str) -> lint.Wiki:
    c = _components(spark, d)
    pages = files.pages_of_documents(_documents(spark, d))
    sources = c.select(F.col("repo_name").alias("name"), F.lit("retracted").alias("status")).distinct()
    d2 = _documents(spark, d)
    hits = d2.where("lang = 'en'").select(F.col("doc_key").alias("file_path"), F.to_date("loaded_at").alias("last_hit"))
    flags = d2.where("doc_key is not null").groupBy("doc_key").agg(F.max(F.coalesce(F.col("n_chars") % 7 == 0, F.lit(False))).alias("overview_stale"))
    return lint.Wiki(pages, c, graph.edges_of(c), _modules(spark, d), sources, hits, flags)


def lint_issues(spark: SparkSession, d: str) -> DataFrame:
    """All issues of all checks; English pages were hit when they were loaded, pages of some lengths play stale overviews."""
    return lint.lint(_wiki(spark, d))


def lint_counts(spark: SparkSession, d: str) -> DataFrame:
    """Issues per check and severity."""
    return lint_issues(spark, d).groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"))


def health_score(spark: SparkSession, d: str) -> DataFrame:
    """The score over all checks."""
    return lint.health(lint_issues(spark, d))


def no_outlinks(spark: SparkSession, d: str) -> DataFrame:
    """Wiki pages without links."""
    return lint.no_outlinks(_wiki(spark, d)).select("file")


def orphan_pages(spark: SparkSession, d: str) -> DataFrame:
    """Wiki pages no page links to."""
    return lint.orphan_pages(_wiki(spark, d)).select("file")


def isolated_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with isolated components."""
    return lint.isolated_components(_wiki(spark, d)).select("file", "message")


def unsupported_claims(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose code spans (as claims) lack links in the next two lines."""
    pages = files.pages_of_documents(_documents(spark, d)).select("doc_key", F.regexp_replace("text", r"`([a-z_]+)`", "(confidence: high)").alias("text"))
    return summaries.unsupported_claims(pages).select("doc_key", "claims", "unsupported")


def note_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of documents per language and source."""
    n = _documents(spark, d).select(F.col("source").alias("note_type"), F.array(S.clean_language("lang")).alias("related_modules"), F.col("doc_id").alias("doc_key"))
    return summaries.note_clusters(n)


_ALL = (
    component_changes, component_upsert, symbols_inserted, unchanged_components, file_changes, listed_changes, modified_since, latest_documents, files_removed, edges_after_removal,
    suffix_matches, service_labels, nested_services, component_count, component_list, file_summary, language_counts, extension_languages, file_totals, directory_listing,
    coverage_pct, coverage_low, naming_convention, tree_totals, complex_modules, leaf_listing, entry_points, symbol_map, symbol_links, module_mentions, routing_classes,
    component_sources, parsed_components, parsed_calls, graph_json, chart_elements, index_page, content_hashes, file_hashes, duplicate_sources, minified_files, slugs, note_tags,
    packages, clean_paths, retrieval_stats, stats_ranking, hit_summary, zero_hits, issue_upsert, sessions_2h, sessions_kept, sessions_expired, edit_history, note_states,
    sources_ingested, batch_status, migrated_pages, lint_issues, lint_counts, health_score, no_outlinks, orphan_pages, isolated_files, unsupported_claims, note_clusters,
)
QUERIES = {f.__name__: f for f in _ALL}

_OLD = "old AS (SELECT id, any_value(content_hash) AS content_hash, any_value(ord) AS ord FROM (SELECT DISTINCT id, content_hash, ord FROM components) GROUP BY id)"
_NEW = """new AS (SELECT id, CASE WHEN ord % 7 = 0 THEN content_hash || 'x' ELSE content_hash END AS content_hash FROM old WHERE ord % 11 <> 0
  UNION ALL SELECT id || '_new', content_hash FROM old WHERE ord % 13 = 0)"""
_ST = f"WITH {_OLD}, {_NEW}"
_P = q.clean_path("relative_path")
_LANG = "CASE WHEN {0} IS NULL OR lower(trim({0})) IN ('', 'none', 'null', 'unknown') THEN 'unknown' ELSE lower(trim({0})) END"
_TYPE = "lower(trim(CASE WHEN regexp_matches(coalesce(component_type, ''), '\\S') THEN component_type ELSE node_type END))"
_GONE = "gone AS (SELECT DISTINCT regexp_replace(relative_path, '^[^/]*/', '') AS f FROM source_files WHERE file_id % 6 = 0)"
_RM = f"rm AS (SELECT DISTINCT c.id FROM (SELECT DISTINCT id, {_P} AS p FROM components) c JOIN gone g ON c.p = g.f OR (contains(g.f, '/') AND ends_with(c.p, '/' || g.f)))"
_HITS = "hits AS (SELECT CAST(user_id AS VARCHAR) AS file_path, event_type AS query, ts AS t FROM events)"
_FNV = """lpad(format('{:x}', list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INT), 1)) AS HUGEINT))),
   lambda acc, b: (xor(acc, b) * 16777619) % 4294967296)), 8, '0')"""
_MODS = f"""f AS (SELECT DISTINCT repo_name, id, array_to_string(list_slice(string_split({_P}, '/'), 1, 2), '/') AS folder FROM components),
   mods AS (SELECT DISTINCT repo_name AS module, CAST(NULL AS VARCHAR) AS component_id FROM f UNION ALL SELECT folder, id FROM f)"""
_PE = f"WITH RECURSIVE {q.PAGES.strip()}, {q.LINK_GRAPH.strip()}"
SQL = {
    "component_changes": f"""{_ST} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'deleted' ELSE 'modified' END AS change
        FROM old a FULL JOIN new b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.content_hash <> b.content_hash""",
    "component_upsert": f"{_ST} SELECT id, content_hash FROM new UNION ALL SELECT id, content_hash FROM old WHERE id NOT IN (SELECT id FROM new)",
    "symbols_inserted": f"{_ST} SELECT id, content_hash FROM old UNION ALL SELECT id, content_hash FROM new WHERE id NOT IN (SELECT id FROM old)",
    "unchanged_components": f"{_ST} SELECT id FROM old EXCEPT SELECT id FROM new",
    "file_changes": """WITH o AS (SELECT relative_path AS p, any_value(content_hash) AS h, any_value(size) AS s, any_value(file_id) AS i, any_value(mtime) AS m FROM source_files GROUP BY 1),
        n AS (SELECT CASE WHEN i % 8 = 0 THEN p || '.moved' ELSE p END AS p, m + CASE i % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 ELSE 0.0 END AS m, CASE WHEN i % 11 = 0 THEN s + 1 ELSE s END AS s,
          CASE WHEN i % 5 = 0 THEN h || 'x' WHEN i % 3 <> 0 THEN h END AS h FROM o WHERE i % 9 <> 0)
        SELECT coalesce(o.p, n.p) AS file_path, CASE WHEN o.p IS NULL THEN 'new' WHEN n.p IS NULL THEN 'vanished' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.p = n.p
        WHERE o.p IS NULL OR n.p IS NULL OR o.s IS DISTINCT FROM n.s OR CASE WHEN o.h IS NOT NULL AND n.h IS NOT NULL THEN o.h <> n.h ELSE coalesce(abs(o.m - n.m) > 1, false) END""",
    "listed_changes": "SELECT DISTINCT substr(relative_path, length('indigo-ledger/') + 1) AS file FROM source_files WHERE starts_with(relative_path, 'indigo-ledger/')",
    "modified_since": "SELECT DISTINCT relative_path AS file_path FROM source_files WHERE mtime > 1740000000",
    "latest_documents": "SELECT doc_key, arg_max(doc_id, (updated_at, doc_id)) AS doc_id FROM documents WHERE doc_key IS NOT NULL GROUP BY doc_key",
    "files_removed": f"WITH {_GONE}, {_RM} SELECT DISTINCT id FROM components WHERE id NOT IN (SELECT id FROM rm)",
    "edges_after_removal": f"WITH {q.EDGES.strip()}, {_GONE}, {_RM} SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM rm) AND dst NOT IN (SELECT id FROM rm)",
    "suffix_matches": f"""WITH asked AS (SELECT DISTINCT regexp_replace(relative_path, '^[^/]*/', '') AS file FROM source_files UNION SELECT file_path FROM source_files), a2 AS (SELECT file, ltrim({q.clean_path('file')}, '/') AS f FROM asked),
        c AS (SELECT DISTINCT id, {_P} AS p FROM components)
        SELECT DISTINCT a2.file, c.id FROM a2 JOIN c ON a2.f = c.p OR ends_with(a2.f, '/' || c.p) OR ends_with(c.p, '/' || a2.f)""",
    "service_labels": """WITH f AS (SELECT DISTINCT relative_path AS file, string_split(relative_path, '/') AS p FROM source_files),
        s AS (SELECT DISTINCT p[1] || '/' || p[2] AS s FROM f WHERE p[2] IN ('src', 'lib', 'pkg') UNION SELECT p[1] FROM f WHERE starts_with(file, 'i'))
        SELECT file, coalesce(arg_max(s, length(s)), '_root') AS service FROM f LEFT JOIN s ON file = s OR starts_with(file, s || '/') GROUP BY file""",
    "nested_services": """WITH f AS (SELECT string_split(relative_path, '/') AS p, relative_path AS r FROM source_files),
        s AS (SELECT array_to_string(list_slice(p, 1, 2), '/') AS s FROM f WHERE length(r) % 2 = 0 UNION SELECT array_to_string(list_slice(p, 1, 3), '/') FROM f)
        SELECT s AS name, s AS relative_path FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE starts_with(s.s, t.s || '/'))""",
    "component_count": "SELECT count(DISTINCT id) AS n_components FROM components",
    "component_list": f"SELECT DISTINCT id, {_TYPE} AS type, {_P} AS file FROM components WHERE starts_with({_P}, 'indigo-ledger/') AND {_TYPE} = 'method'",
    "file_summary": f"""WITH c AS (SELECT DISTINCT id, {_P} AS file, {_TYPE} AS type, name FROM components),
        t AS (SELECT file, type, count(*) AS n FROM c GROUP BY ALL)
        SELECT file, sum(n) AS n, string_agg(type || '=' || n, ',' ORDER BY type) AS types,
          coalesce((SELECT string_agg(x.name, ',' ORDER BY x.name) FROM (SELECT DISTINCT name FROM c WHERE c.file = t.file AND c.type IN ('class', 'struct', 'interface')) x), '') AS classes FROM t GROUP BY file""",
    "language_counts": f"SELECT {_LANG.format('language')} AS language, count(*) AS n FROM source_files GROUP BY 1",
    "extension_languages": """WITH e AS (SELECT DISTINCT repo_name, relative_path, regexp_extract(relative_path, '\\.([A-Za-z+]+)$', 1) AS x FROM source_files)
        SELECT CASE x WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' ELSE x END AS language, true AS supported, count(*) AS n FROM e WHERE x IN ('py', 'js', 'ts', 'java', 'go') GROUP BY 1""",
    "file_totals": "SELECT count(*) AS n_files, round(sum(size) / 1024.0, 3) AS total_kb FROM (SELECT DISTINCT relative_path, size FROM source_files)",
    "directory_listing": """WITH f AS (SELECT DISTINCT relative_path, size, substr(relative_path, 15) AS p FROM source_files WHERE starts_with(relative_path, 'indigo-ledger/'))
        SELECT split_part(p, '/', 1) AS entry, CASE WHEN contains(p, '/') THEN 'folder' ELSE 'file' END AS kind, count(*) AS n_files, sum(size) AS size FROM f GROUP BY ALL""",
    "coverage_pct": """WITH c AS (SELECT id, max(CASE WHEN len(parameters) > 0 THEN 1 ELSE 0 END) AS k FROM components GROUP BY id)
        SELECT count(*) AS total, sum(k) AS documented, round(avg(k) * 100, 2) AS percent FROM c""",
    "coverage_low": """WITH c AS (SELECT DISTINCT id, repo_name, coalesce(has_docstring, false) AS k FROM components)
        SELECT repo_name, count(*) AS total, count(*) FILTER (k) AS documented, round(count(*) FILTER (k) * 100.0 / count(*), 2) AS percent FROM c GROUP BY repo_name HAVING count(*) FILTER (k) * 100.0 / count(*) < 50""",
    "naming_convention": """WITH c AS (SELECT DISTINCT id, split_part(name, '.', -1) AS n FROM components WHERE name IS NOT NULL)
        SELECT CASE WHEN regexp_full_match(n, '[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+') THEN 'PascalCase' WHEN regexp_full_match(n, '[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+') THEN 'camelCase'
          WHEN regexp_full_match(n, '[a-z0-9]+(?:_[a-z0-9]+)+') THEN 'snake_case' WHEN regexp_full_match(n, '[a-z0-9]+(?:-[a-z0-9]+)+') THEN 'kebab-case'
          WHEN regexp_full_match(n, '[A-Z0-9]+(?:_[A-Z0-9]+)*') THEN 'UPPER_CASE' ELSE 'other' END AS style, count(*) AS n FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "tree_totals": f"WITH {_MODS} SELECT count(DISTINCT module) AS n_modules, count(component_id) AS n_components FROM mods",
    "complex_modules": f"WITH {_MODS}, cf AS (SELECT DISTINCT id, {_P} AS p FROM components) SELECT module, count(DISTINCT p) AS n_files FROM mods JOIN cf ON cf.id = component_id GROUP BY module HAVING count(DISTINCT p) > 1",
    "symbol_map": f"SELECT name, min(f) AS file, count(*) AS n_files FROM (SELECT DISTINCT name, {_P} AS f FROM components WHERE lower(trim(component_type)) IN ('class', 'interface', 'struct', 'enum', 'record')) GROUP BY name",
    "symbol_links": f"""WITH {q.PAGES}, n AS (SELECT split_part(name, '.', -1) AS symbol, min({_P}) AS file FROM components GROUP BY 1)
        SELECT DISTINCT doc_key, symbol, file FROM (SELECT doc_key, unnest(regexp_extract_all(text, '`([A-Za-z_][\\w.]*)(?:\\(\\))?`', 1)) AS symbol FROM pages) JOIN n USING (symbol)""",
    "routing_classes": f"""WITH c AS (SELECT DISTINCT id, lower(name) AS n, '/' || lower({_P}) || '/' AS p, left(coalesce(source_code, ''), 2000) AS h FROM components UNION ALL SELECT p_name, lower(split_part(p_name, ' ', 1)) || CASE p_size % 4 WHEN 0 THEN 'dto' WHEN 1 THEN 'client' WHEN 2 THEN 'service' ELSE '' END, '/src/' || lower(split_part(p_type, ' ', 1)) || '/', CASE WHEN p_size % 5 = 0 THEN '@Bean' ELSE '' END FROM part)
        SELECT CASE WHEN regexp_matches(n, '(dto|vo|request|response|entity|po|do|model|schema|form|serializer|mapper|repository|dao|dataclass)$') OR regexp_matches(p, '/(model|models|dto|vo|entity|entities|schema|pojo)/')
            OR regexp_matches(h, '@Data|@Getter|@Setter|@Entity|@Table|@Document') THEN 'boilerplate'
          WHEN regexp_matches(n, '(util|utils|helper|factory|builder|interceptor|filter|middleware|adapter|wrapper|proxy|client|config|configuration|properties)$') OR regexp_matches(p, '/(util|utils|config|infrastructure|common|shared)/')
            OR regexp_matches(h, '@Configuration|@ConfigurationProperties|@Bean') THEN 'infra'
          ELSE 'business' END AS class, count(*) AS n FROM c GROUP BY 1""",
    "leaf_listing": f"""WITH c AS (SELECT id, any_value({_P}) AS file, any_value(source_code) AS s, any_value(lower(trim(component_type))) AS t FROM components GROUP BY id),
        {q.EDGES.strip()}, k AS (SELECT * FROM c WHERE t IN ('class', 'interface', 'struct') AND NOT regexp_matches(lower(id), 'error|exception|failed|invalid')),
        d AS (SELECT * FROM k WHERE (SELECT count(*) FROM k) < greatest(400, floor((SELECT count(*) FROM c) * 0.05)) OR id NOT IN (SELECT dst FROM edges WHERE src <> dst))
        SELECT file, count(*) AS n, sum(ceil(length(coalesce(s, '')) / 4.0)) AS tokens FROM d GROUP BY file""",
    "batch_status": """WITH b AS (SELECT doc_id AS item, CASE WHEN starts_with(source, 'notes-') THEN 'note' WHEN source = 'raw-sources' THEN 'source' END AS kind, title, text FROM documents),
        e AS (SELECT *, CASE WHEN kind IS NULL THEN 'unknown kind' WHEN trim(coalesce(text, ''), ' ') = '' THEN 'no content' WHEN kind = 'note' AND trim(coalesce(title, ''), ' ') = '' THEN 'no title' END AS error FROM b),
        r AS (SELECT *, min(CASE WHEN error IS NULL THEN item END) OVER (PARTITION BY coalesce(text, ''), kind) AS first FROM e)
        SELECT kind, CASE WHEN error IS NOT NULL THEN 'failed' WHEN item = first THEN 'ingested' ELSE 'repeat' END AS status, error, count(*) AS n FROM r GROUP BY ALL""",
    "migrated_pages": f"""WITH {q.PAGES}, k AS (SELECT doc_key, text, {q.fm_text('text')} AS fm, CASE WHEN contains(lower(doc_key), 'notes/') THEN 'note' WHEN contains(lower(doc_key), 'raw/sources') THEN 'source'
          WHEN contains(lower(doc_key), '/entities/') THEN 'entity' WHEN contains(lower(doc_key), '/concepts/') THEN 'concept' ELSE 'module' END AS kind FROM pages)
        SELECT doc_key, NOT regexp_matches(fm, '(?m)^type:\\s*\\S') AS changed, md5(CASE WHEN regexp_matches(fm, '(?m)^type:\\s*\\S') THEN text
          WHEN fm = '' THEN '---' || chr(10) || 'type: ' || kind || chr(10) || 'status: stable' || chr(10) || 'stale_after: 2025-08-30' || chr(10) || '---' || chr(10) || text
          ELSE '---' || chr(10) || 'type: ' || kind || chr(10) || regexp_replace(text, '\\A\\x{{FEFF}}?---\\r?\\n', '') END) AS text_md5 FROM k""",
    "module_mentions": f"""WITH {q.PAGES}, m AS (SELECT DISTINCT repo_name AS module FROM components), w AS (SELECT module, unnest(list_distinct(string_split(lower(module), '-'))) AS word, len(list_distinct(string_split(lower(module), '-'))) AS n FROM m),
        hit AS (SELECT doc_key, module, any_value(n) AS n, count(*) AS found FROM pages JOIN w ON contains(lower(text), word) GROUP BY ALL)
        SELECT doc_key, module FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY module) AS k FROM hit WHERE (n = 1 AND found = 1) OR (n > 1 AND found >= n // 2)) WHERE k <= 5""",
    "content_hashes": "SELECT id, left(sha256(source_code), 16) AS h FROM (SELECT DISTINCT id, source_code FROM components WHERE source_code IS NOT NULL)",
    "file_hashes": "SELECT DISTINCT relative_path, sha256(file_text) AS h FROM source_files WHERE file_text IS NOT NULL",
    "duplicate_sources": "SELECT sha256(text) AS content_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "minified_files": """WITH f AS (SELECT DISTINCT relative_path, length(file_text) AS s, string_split(file_text, chr(10)) AS l FROM source_files WHERE file_text IS NOT NULL)
        SELECT relative_path FROM f WHERE s >= 4096 AND (s / len(l) > 300 OR (s > 10240 AND len(l) < s / 500) OR (len(l) < 20 AND list_max(list_transform(l, lambda x: length(x))) > 5000))""",
    "slugs": f"SELECT title, {q.slug('title')} AS slug FROM (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL)",
    "note_tags": """SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_concat(['note'],
          list_concat(list_transform(regexp_extract_all(coalesce(title || ' ', '') || text, '#([\\p{L}\\p{N}_]+)', 1), lambda x: lower(x)),
          list_transform(regexp_extract_all(substr(text, 1, 500), '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1), lambda x: lower(x)))))), 1, 15), ',') AS tags FROM documents WHERE text IS NOT NULL""",
    "packages": """WITH c AS (SELECT DISTINCT id, string_split(qualified_name, '.') AS p, lower(node_type) AS t FROM components)
        SELECT CASE WHEN len(p) < 2 THEN '' WHEN t = 'method' AND len(p) >= 3 THEN array_to_string(p[:-3], '.') ELSE array_to_string(p[:-2], '.') END AS package, count(*) AS n FROM c GROUP BY 1""",
    "clean_paths": f"SELECT DISTINCT id, {_P} AS path, len(list_filter(string_split({_P}, '/'), lambda x: x <> '')) - 1 AS depth FROM components",
    "retrieval_stats": f"WITH {_HITS} SELECT file_path, count(*) AS hit_count, CAST(CAST(min(t) AS DATE) AS VARCHAR) AS first_hit, CAST(CAST(max(t) AS DATE) AS VARCHAR) AS last_hit FROM hits GROUP BY file_path",
    "stats_ranking": f"WITH {_HITS} SELECT file_path, count(*) AS hit_count FROM hits GROUP BY file_path HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 50",
    "hit_summary": f"""WITH {_HITS}, c AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS f FROM customer)
        SELECT (SELECT count(DISTINCT query) FROM hits) AS n_queries, count(*) AS n_files, count(*) FILTER (f IN (SELECT file_path FROM hits)) AS n_hit,
          round(avg(CASE WHEN f IN (SELECT file_path FROM hits) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM c""",
    "zero_hits": f"WITH {_HITS} SELECT CAST(c_custkey AS VARCHAR) AS file_path FROM customer EXCEPT SELECT file_path FROM hits",
    "issue_upsert": f"""SELECT {_FNV} AS issue_id, issue_type, page_path, n AS occurrences FROM (
        SELECT event_type AS issue_type, CAST(user_id AS VARCHAR) AS page_path, event_type || '::' || user_id AS k, count(*) AS n FROM events GROUP BY ALL)""",
    "sessions_2h": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, CAST(min(ts) AS VARCHAR) AS started, count(*) AS n_events FROM g GROUP BY user_id, k""",
    "sessions_kept": "SELECT user_id, CAST(max(ts) AS VARCHAR) AS last_access FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 10",
    "sessions_expired": "SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-21 00:00:00' GROUP BY event_type",
    "edit_history": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3",
    "note_states": """WITH e AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'draft' ELSE 'deprecated' END AS s FROM orders)
        SELECT s AS status, count(*) AS n, sum(k) AS confirmations FROM (SELECT o_custkey, arg_max(s, (o_orderdate, o_orderkey)) AS s, count(*) FILTER (s = 'stable') AS k FROM e GROUP BY o_custkey) GROUP BY s""",
    "sources_ingested": """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS h, updated_at AS t FROM documents WHERE text IS NOT NULL),
        f AS (SELECT arg_min(name, (t, name)) AS name FROM a GROUP BY h)
        SELECT name, CASE WHEN CAST(name AS BIGINT) % 10 = 0 THEN 'retracted' ELSE 'active' END AS status FROM f""",
    "no_outlinks": f"{_PE} SELECT doc_key AS file FROM pages WHERE source = 'doc' AND NOT regexp_matches(lower(doc_key), '(^|/)(index|log|overview)\\.md$') AND doc_key NOT IN (SELECT source_doc FROM wl UNION SELECT source_doc FROM ml)",
    "orphan_pages": f"""{_PE} SELECT doc_key AS file FROM pages WHERE source = 'doc' AND NOT regexp_matches(lower(doc_key), '(^|/)(index|log|overview)\\.md$')
        AND doc_key NOT IN (SELECT doc_key FROM wres UNION SELECT doc_key FROM mkeys WHERE doc_key IS NOT NULL)""",
    "isolated_files": f"""WITH {q.EDGES.strip()}, i AS (SELECT DISTINCT id, {_P} AS f FROM components WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges))
        SELECT f AS file, 'isolated components: ' || count(*) AS message FROM i GROUP BY f ORDER BY count(*) DESC, f LIMIT 20""",
    "unsupported_claims": f"""WITH {q.PAGES}, l AS (SELECT doc_key, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_key, {q.lines("regexp_replace(text, '`([a-z_]+)`', '(confidence: high)', 'g')")} AS ls FROM pages)),
        w AS (SELECT doc_key, line, concat_ws(chr(10), line, lead(line, 1) OVER p, lead(line, 2) OVER p) AS near FROM l WINDOW p AS (PARTITION BY doc_key ORDER BY no)),
        c AS (SELECT doc_key, CASE WHEN contains(line, '[candidate]') OR NOT regexp_matches(near, '\\[\\^src:|\\]\\([^)]*\\)|(?i)evidence:') THEN 1 ELSE 0 END AS bad FROM w WHERE regexp_matches(line, '\\(confidence:\\s*[^)]+\\)'))
        SELECT doc_key, count(*) AS claims, sum(bad) AS unsupported FROM c GROUP BY doc_key HAVING sum(bad) * 1.0 / count(*) > 0.3""",
    "note_clusters": f"SELECT {_LANG.format('lang')} AS module, source AS note_type, count(DISTINCT doc_id) AS n FROM documents GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3",
    "entry_points": f"""WITH c AS (SELECT DISTINCT id, lower(split_part(name, '.', -1)) AS n, lower(split_part({_P}, '/', -1)) AS f, {_TYPE} AS t FROM components
          UNION ALL SELECT id, lower(split_part(split_part(id, '::', 2), '.', -1)), lower(split_part(split_part(id, '::', 1), '/', -1)), component_type FROM ({samples.SQL["sample_components"]})),
        s AS (SELECT id, CASE WHEN n IN ('main', 'run', 'start', 'serve', 'handler', 'lambda_handler', 'app', 'init', 'bootstrap') THEN 3 ELSE 0 END
          + CASE WHEN regexp_matches(f, '^(main|index|app|server|cli|__main__|program|manage)\\.') THEN 2 ELSE 0 END + CASE WHEN t = 'function' THEN 1 ELSE 0 END AS score FROM c)
        SELECT id, score FROM s WHERE score >= 2 ORDER BY score DESC, id LIMIT 20""",
    "graph_json": f"""WITH {q.EDGES.strip()}, d AS (SELECT src, string_agg(CAST(to_json(dst) AS VARCHAR), ',' ORDER BY dst) AS deps FROM edges GROUP BY src), c AS (SELECT DISTINCT id, name, component_type, relative_path FROM components)
        SELECT id, '{{' || concat_ws(',', '"id":' || to_json(id), '"name":' || to_json(name), '"component_type":' || to_json(component_type), '"relative_path":' || to_json(relative_path), '"depends_on":[' || coalesce(deps, '') || ']') || '}}' AS node
        FROM c LEFT JOIN d ON d.src = id""",
    "index_page": f"WITH {q.PAGES} SELECT source AS section, '- [' || coalesce(title, doc_key) || '](' || doc_key || ')' AS line FROM pages",
    "chart_elements": f"""WITH {q.EDGES.strip()}, c AS (SELECT DISTINCT id, name, component_type FROM components)
        SELECT 'node' AS kind, '{{"data":{{' || concat_ws(',', '"id":' || to_json(id), '"label":' || to_json(name), '"type":' || to_json(component_type)) || '}}}}' AS element FROM c
        UNION ALL SELECT 'edge', '{{"data":{{' || concat_ws(',', '"id":' || to_json(src || '->' || dst), '"source":' || to_json(src), '"target":' || to_json(dst)) || '}}}}' FROM edges""",
    "component_sources": f"""WITH f AS (SELECT relative_path AS p, any_value(file_text) AS t FROM source_files WHERE file_text IS NOT NULL GROUP BY 1),
        c AS (SELECT DISTINCT id, start_line AS s, end_line AS e, {_P} AS p FROM components)
        SELECT id, md5(CASE WHEN s IS NULL OR s < 1 THEN t ELSE array_to_string(list_slice(string_split(t, chr(10)), s, coalesce(e, s)), chr(10)) END) AS source_md5 FROM c JOIN f USING (p)""",
}
SQL |= lintsql.SQL
