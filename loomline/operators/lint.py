"""Documentation checks: each gives rows (check, severity, file, line, message); `lint` selects, merges and scores them.

Pages are rows (doc_key, source, title, text); `source` is doc, note or source. Texts are read once, by `parse_pages`,
into what the checks look at (links with their lines, names, front matter, claims); `lint` keeps that, without the
texts, and all checks read it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.scalar import front_matter, front_matter_list, front_matter_value, is_stale, norm_status, page_hrefs, source_refs, strip_code_blocks, wikilinks
from loomline.operators import graph, links, summaries
from loomline.session import ensure_checkpoint_dir

SEVERITIES = {"error": 0, "warning": 1, "info": 2}


@dataclass
class Wiki:
    """What the checks look at; tables that are missing leave their checks without rows."""

    pages: DataFrame
    components: DataFrame | None = None
    edges: DataFrame | None = None
    modules: DataFrame | None = None
    sources: DataFrame | None = None  # name, status
    retrievals: DataFrame | None = None  # file_path, last_hit
    flags: DataFrame | None = None  # doc_key, overview_stale
    today: str = "2025-12-31"


def _issue(rows: DataFrame, check: str, severity: str, file: Column | str, message: Column, line: Column | None = None) -> DataFrame:
    at = F.lit(None).cast("int") if line is None else line.cast("int")
    f = F.col(file) if isinstance(file, str) else file
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), f.cast("string").alias("file"), at.alias("line"), message.alias("message"))


def parse_pages(pages: DataFrame) -> DataFrame:
    """What the checks look at of each page, its text read once."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(strip_code_blocks(text), r"\r?\n")
    return pages.select("doc_key", "source", "title", "text", lines.alias("__lines"), front_matter("text").alias("fm")).select(
        "doc_key", "source", (F.col("fm") != "").alias("has_front_matter"),
        F.filter(F.transform("__lines", lambda x, i: F.struct((i + 1).alias("no"), F.array_distinct(page_hrefs(x)).alias("hrefs"))), lambda x: F.size(x["hrefs"]) > 0).alias("md"),
        wikilinks("text").alias("wiki"), page_hrefs("text").alias("hrefs"), links.names_of_page().alias("names"),
        source_refs("text").alias("refs"),
        *(front_matter_value("text", k).alias(k) for k in ("status", "type", "stale_after", "superseded_by", "date")),
        F.size(front_matter_list("text", "aliases")).alias("n_aliases"), front_matter_list("text", "related_modules").alias("related_modules"),
        F.col("fm").rlike(r"(?m)^verified:[ \t]*\r?\n[ \t]+[A-Za-z_]+:").alias("verified_mapping"), summaries.claims("text").alias("claim"),
    )


def _parsed(w: Wiki) -> DataFrame:
    return w.pages if "md" in w.pages.columns else parse_pages(w.pages)


def _href_lines(w: Wiki) -> DataFrame:
    return _parsed(w).select("doc_key", F.explode("md").alias("m")).select("doc_key", F.col("m.no").alias("no"), F.explode("m.hrefs").alias("href"))


def broken_links(w: Wiki) -> DataFrame:
    """error: a link to a page that does not exist."""
    keys = _parsed(w).select(F.col("doc_key").alias("to")).distinct()
    rows = _href_lines(w).withColumn("to", links.resolve_href("doc_key", "href")).join(keys, "to", "left_anti")
    rows = rows.withColumn("to", F.concat(F.lit("wiki/"), "to")).join(keys, "to", "left_anti")
    return _issue(rows, "broken_links", "error", "doc_key", F.concat(F.lit("broken link: "), "href"), F.col("no"))


def stale_refs(w: Wiki) -> DataFrame:
    """error: a link to the page of a module that is no more in the tree; needs a module tree."""
    if w.modules is None:
        return broken_links(w).where(F.lit(False))
    names = w.modules.select(F.regexp_replace(F.lower("module"), r"[\s/\\]+", "_").alias("stem")).distinct()
    keys = _parsed(w).select(F.lower(F.regexp_replace(F.regexp_extract("doc_key", r"([^/]*)$", 1), r"\.md$", "")).alias("stem")).distinct()
    rows = _href_lines(w).withColumn("stem", F.lower(F.regexp_replace(F.regexp_extract("href", r"([^/]*)$", 1), r"\.md$", "")))
    rows = rows.join(names, "stem", "left_anti").join(keys, "stem", "left_anti")
    return _issue(rows, "stale_refs", "error", "doc_key", F.concat(F.lit("stale reference: "), "href"), F.col("no"))


def undocumented(w: Wiki, least: int = 5) -> DataFrame:
    """warning: a component with at least `least` dependents that no module lists."""
    rows = graph.in_degrees(w.edges).where(F.col("dependents") >= least)
    rows = rows.join(w.modules.select(F.col("component_id").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    return _issue(rows, "undocumented", "warning", "id", F.concat(F.lit("undocumented, dependents: "), F.col("dependents").cast("string")))


def cycles(w: Wiki, most: int = 10) -> DataFrame:
    """info: the first dependency cycles, by their least id."""
    rows = graph.components_scc(w.edges).groupBy("scc").agg(F.count(F.lit(1)).alias("n")).orderBy("scc").limit(most)
    return _issue(rows, "cycles", "info", "scc", F.concat(F.lit("cycle of "), F.col("n").cast("string")))


def isolated_components(w: Wiki, most: int = 20) -> DataFrame:
    """info: files with components that nothing refers to and that refer to nothing."""
    rows = summaries.isolated_by_file(graph.isolated_nodes(w.components, w.edges), w.components, most)
    return _issue(rows, "isolated_components", "info", "file", F.concat(F.lit("isolated components: "), F.col("n").cast("string")))


def coverage(w: Wiki) -> DataFrame:
    """info: the share of components that modules list."""
    return _issue(summaries.coverage(w.components, w.modules), "coverage", "info", F.lit(None), F.concat(F.lit("coverage: "), F.col("percent").cast("string")))


def _wiki_pages(w: Wiki) -> DataFrame:
    return _parsed(w).where((F.col("source") == "doc") & ~F.lower("doc_key").rlike(r"(^|/)(?:index|log|overview)\.md$"))


def orphan_pages(w: Wiki) -> DataFrame:
    """warning: a page no page links to (a link to itself counts)."""
    p = _parsed(w)
    to = p.select(F.explode("wiki").alias("target")).distinct()
    named = links.resolve_names(to, links.first_of_names(p)).select("doc_key")
    href = p.select(F.col("doc_key").alias("source_doc"), F.explode("hrefs").alias("target")).select(links.resolve_href("source_doc", "target").alias("r")).distinct()
    md = href.select(F.explode(F.array("r", F.concat(F.lit("wiki/"), "r"))).alias("doc_key"))
    rows = _wiki_pages(w).select("doc_key").distinct().join(named.unionByName(md).distinct(), "doc_key", "left_anti")
    return _issue(rows, "orphan_pages", "warning", "doc_key", F.lit("no page links here"))


def no_outlinks(w: Wiki) -> DataFrame:
    """info: a page without links."""
    rows = _wiki_pages(w).groupBy("doc_key").agg(F.max(F.size("wiki") + F.size("hrefs")).alias("n")).where("n = 0")
    return _issue(rows, "no_outlinks", "info", "doc_key", F.lit("links to no page"))


def missing_aliases(w: Wiki) -> DataFrame:
    """info, one row: how many pages give no other names."""
    rows = _wiki_pages(w).where("n_aliases = 0").agg(F.count(F.lit(1)).alias("n"), F.min("doc_key").alias("doc_key")).where("n > 0")
    return _issue(rows, "missing_aliases", "info", "doc_key", F.concat(F.lit("pages without aliases: "), F.col("n").cast("string")))


def stale_sources(w: Wiki) -> DataFrame:
    """warning: a page that refers to a retracted source; names may hold hyphens."""
    gone = w.sources.where("status = 'retracted'").select("name").distinct()
    rows = _parsed(w).select("doc_key", F.explode("refs").alias("name")).join(gone, "name")
    return _issue(rows, "stale_sources", "warning", "doc_key", F.concat(F.lit("retracted source: "), "name"))


def superseded_pages(w: Wiki) -> DataFrame:
    """info: a page that another one supersedes."""
    rows = _parsed(w).where("superseded_by is not null")
    return _issue(rows, "superseded_pages", "info", "doc_key", F.concat(F.lit("superseded by "), "superseded_by"))


def overview_stale(w: Wiki) -> DataFrame:
    """warning: an overview that is marked as stale."""
    return _issue(w.flags.where("overview_stale"), "overview_stale", "warning", "doc_key", F.lit("overview is stale"))


def unsupported_claims(w: Wiki, share: float = 0.3) -> DataFrame:
    """warning: a page with too many claims without evidence."""
    rows = _parsed(w).select("doc_key", "claim.*").where(F.col("unsupported") > share * F.col("claims"))
    return _issue(rows, "unsupported_claims", "warning", "doc_key", F.concat(F.lit("unsupported claims: "), F.col("unsupported").cast("string"), F.lit(" of "), F.col("claims").cast("string")))


def stale_notes(w: Wiki, days: int = 90, gap: int = 60) -> DataFrame:
    """warning: a stable note older than `days` that no search hit within `gap` days."""
    notes = _parsed(w).where("source = 'note'").select("doc_key", norm_status("status").alias("status"), F.try_to_date(F.substring("date", 1, 10), "yyyy-MM-dd").alias("day"))
    old = notes.where((F.col("status") == "stable") & (F.date_add("day", days) < F.to_date(F.lit(w.today))))
    if w.retrievals is not None:
        hit = w.retrievals.groupBy(F.col("file_path").alias("doc_key")).agg(F.max("last_hit").alias("last_hit"))
        old = old.join(hit, "doc_key", "left").where(F.coalesce(F.date_add("last_hit", gap) < F.to_date(F.lit(w.today)), F.lit(True)))
    return _issue(old, "stale_notes", "warning", "doc_key", F.lit("stable, old and not searched for"))


def note_clusters(w: Wiki, least: int = 3) -> DataFrame:
    """info: modules with at least `least` notes of one type."""
    notes = _parsed(w).where("source = 'note'").select("doc_key", F.coalesce("type", F.lit("note")).alias("note_type"), "related_modules")
    rows = summaries.note_clusters(notes, least)
    return _issue(rows, "note_clusters", "info", "module", F.concat(F.col("note_type"), F.lit(" notes: "), F.col("n").cast("string")))


def conformance(w: Wiki) -> DataFrame:
    """Front matter rules: missing front matter (error), missing type (error), a status outside the vocabulary (warning),
    verified written as a mapping (warning), expired stale_after (warning)."""
    def found(test: Column, severity: str, message: Column) -> Column:
        return F.when(test, F.struct(F.lit(severity).alias("severity"), message.alias("message")))

    has = F.col("has_front_matter")
    every = F.array(
        found(~has, "error", F.lit("no front matter")),
        found(has & F.col("type").isNull(), "error", F.lit("no type")),
        found(has & F.col("status").isNotNull() & ~F.lower("status").isin("draft", "stable", "deprecated"), "warning", F.concat(F.lit("unknown status: "), "status")),
        found(has & F.col("verified_mapping"), "warning", F.lit("verified is not a list")),
        found(has & is_stale("stale_after", F.lit(w.today)), "warning", F.concat(F.lit("expired: "), "stale_after")),
    )
    rows = _parsed(w).select("doc_key", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("i"))
    return rows.select(F.lit("conformance").alias("check"), "i.severity", F.col("doc_key").cast("string").alias("file"), F.lit(None).cast("int").alias("line"), "i.message")


CHECKS: dict[str, tuple[Callable[[Wiki], DataFrame], tuple[str, ...]]] = {
    "stale_refs": (stale_refs, ("modules",)), "broken_links": (broken_links, ()), "undocumented": (undocumented, ("edges", "modules")),
    "cycles": (cycles, ("edges",)), "isolated_components": (isolated_components, ("components", "edges")), "coverage": (coverage, ("components", "modules")),
    "orphan_pages": (orphan_pages, ()), "no_outlinks": (no_outlinks, ()), "missing_aliases": (missing_aliases, ()), "stale_sources": (stale_sources, ("sources",)),
    "superseded_pages": (superseded_pages, ()), "overview_stale": (overview_stale, ("flags",)), "unsupported_claims": (unsupported_claims, ()),
    "stale_notes": (stale_notes, ()), "note_clusters": (note_clusters, ()), "conformance": (conformance, ()),
}


def lint(w: Wiki, checks: Sequence[str] | None = None, floor: str = "info") -> DataFrame:
    """The issues of the chosen checks (all whose tables are there), down to a severity; broken links that are stale
    references too (same file and line) come out once, as stale references."""
    ensure_checkpoint_dir(w.pages.sparkSession)
    w = replace(w, pages=_parsed(w).checkpoint())
    if w.edges is not None:
        w = replace(w, edges=w.edges.checkpoint())
    if w.modules is not None:
        w = replace(w, modules=w.modules.select("module", "component_id").checkpoint())
    chosen = [c for c in (checks or CHECKS) if all(getattr(w, t) is not None for t in CHECKS[c][1])]
    parts = {c: CHECKS[c][0](w) for c in chosen}
    if "broken_links" in parts and "stale_refs" in parts:
        at = parts["stale_refs"].select("file", "line").distinct()
        parts["broken_links"] = parts["broken_links"].join(at, ["file", "line"], "left_anti").select("check", "severity", "file", "line", "message")
    out = None
    for p in parts.values():
        out = p if out is None else out.unionByName(p)
    kept = [s for s, n in SEVERITIES.items() if n <= SEVERITIES[floor]]
    return out.where(F.col("severity").isin(kept))


def in_order(issues: DataFrame) -> DataFrame:
    """Issues in their reported order: severity, check, file, line."""
    n = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.orderBy(n, "check", "file", "line", "message")


def health(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos and the score 100 - 10 per error - 3 per warning - 1 per info, at least 0."""
    n = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos"))
    score = F.greatest(F.lit(0), F.lit(100) - 10 * F.col("errors") - 3 * F.col("warnings") - F.col("infos"))
    return n.withColumn("score", score)
