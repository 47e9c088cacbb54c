"""The link graph of wiki pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.scalar import col, extract_title, page_hrefs, slugify, wikilinks
from loomline.operators.skew import salted_join
from loomline.session import ensure_checkpoint_dir


def names_of_page() -> Column:
    """All names a page is found by as structs (name, rank): stems come before titles, titles before slugs."""
    stem = F.lower(F.regexp_replace(F.regexp_extract("doc_key", r"([^/]*)$", 1), r"\.[^.]*$", ""))
    title = F.lower(F.coalesce(extract_title("text"), F.col("title")))
    return F.array(
        F.struct(stem.alias("name"), F.lit(0).alias("rank")), F.struct(title.alias("name"), F.lit(1).alias("rank")),
        F.struct(slugify(title).alias("name"), F.lit(2).alias("rank")),
    )


def first_of_names(named: DataFrame) -> DataFrame:
    """(name, rank, doc_key) from pages (doc_key, names); of several pages with one name of a rank the last key counts."""
    rows = named.select("doc_key", F.explode("names").alias("n")).where(F.col("n.name").isNotNull() & (F.col("n.name") != ""))
    return rows.groupBy(F.col("n.name").alias("name"), F.col("n.rank").alias("rank")).agg(F.max("doc_key").alias("doc_key"))


def page_names(pages: DataFrame) -> DataFrame:
    """All names pages are found by: (name, rank, doc_key)."""
    return first_of_names(pages.select("doc_key", names_of_page().alias("names")))


def resolve_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(target, doc_key) of each wanted name that a page has, by stem, title or slug in this order."""
    asked = wanted.select("target").distinct()
    keyed = asked.select("target", F.lower("target").alias("name")).unionByName(asked.select("target", slugify("target").alias("name"))).distinct()
    return keyed.join(names, "name").groupBy("target").agg(F.min_by("doc_key", F.struct("rank", "doc_key")).alias("doc_key"))


def resolve_href(source_key: Column | str, href: Column | str) -> Column:
    """The key a relative link leads to from a page, `.` and `..` resolved; links from the root begin with `/`."""
    folder = F.regexp_extract(col(source_key), r"^(.*/)?[^/]*$", 1)
    joined = F.when(col(href).startswith("/"), F.substring(col(href), 2, 100_000)).otherwise(F.concat(folder, col(href)))
    parts = F.filter(F.split(joined, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    done = F.aggregate(parts, empty, lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    return F.array_join(done, "/")


def page_links(pages: DataFrame) -> DataFrame:
    """Every link as written: (source_doc, target, link_type)."""
    wiki = pages.select(F.col("doc_key").alias("source_doc"), F.explode(wikilinks("text")).alias("target"), F.lit("wikilink").alias("link_type"))
    md = pages.select(F.col("doc_key").alias("source_doc"), F.explode(page_hrefs("text")).alias("target"), F.lit("markdown").alias("link_type"))
    return wiki.unionByName(md)


def link_graph(pages: DataFrame) -> DataFrame:
    """Distinct links between existing pages: (source_doc, target_doc, link_type), self-links left out; a pair linked in
    both ways has the type that comes first by name."""
    links = page_links(pages).distinct()
    named = resolve_names(links.where("link_type = 'wikilink'"), page_names(pages))
    wiki = salted_join(links.where("link_type = 'wikilink'"), named, ["target"], "inner").select("source_doc", F.col("doc_key").alias("target_doc"), "link_type")
    keys = pages.select(F.col("doc_key").alias("target_doc")).distinct()
    rel = links.where("link_type = 'markdown'").select("source_doc", "link_type", resolve_href("source_doc", "target").alias("a"))
    tries = rel.select("source_doc", "link_type", "a", F.posexplode(F.array("a", F.concat(F.lit("wiki/"), "a"))).alias("rank", "target_doc"))
    md = salted_join(tries, keys, ["target_doc"], "inner").groupBy("source_doc", "link_type", "a").agg(F.min_by("target_doc", "rank").alias("target_doc"))
    both = wiki.unionByName(md.select("source_doc", "target_doc", "link_type")).where("source_doc <> target_doc")
    return both.groupBy("source_doc", "target_doc").agg(F.min("link_type").alias("link_type"))


def broken_links(pages: DataFrame) -> DataFrame:
    """Links that lead to no page: (source_doc, target, link_type)."""
    links = page_links(pages).distinct()
    named = resolve_names(links.where("link_type = 'wikilink'"), page_names(pages))
    wiki = salted_join(links.where("link_type = 'wikilink'"), named, ["target"], "left_anti")
    keys = pages.select(F.col("doc_key").alias("to")).distinct()
    md = links.where("link_type = 'markdown'").withColumn("to", resolve_href("source_doc", "target"))
    lost = salted_join(md, keys, ["to"], "left_anti").withColumn("to", F.concat(F.lit("wiki/"), "to"))
    lost = salted_join(lost, keys, ["to"], "left_anti").drop("to")
    return wiki.select("source_doc", "target", "link_type").unionByName(lost.select("source_doc", "target", "link_type"))


def expand(graph: DataFrame, seeds: DataFrame, hops: int = 1, decay: float = 0.5, least: float = 0.05, most: int = 30) -> DataFrame:
    """Pages near the seeds (doc_key, score) over links in either direction: (doc_key, score, hop, via).

    The score falls by `decay` a hop, scores under `least` are dropped, of several ways the best score (then fewest
    hops, then least `via`) counts, seeds are left out; the `most` best pages are kept, ties by key.
    """
    ensure_checkpoint_dir(graph.sparkSession)
    pairs = graph.select(F.col("source_doc").alias("a"), F.col("target_doc").alias("b"))
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    seen = seeds.select("doc_key").distinct()
    frontier = seeds.select("doc_key", "score")
    found = frontier.select("doc_key", "score", F.lit(0).alias("hop"), F.col("doc_key").alias("via")).where(F.lit(False))
    for hop in range(1, min(3, hops) + 1):
        step = near.join(frontier.withColumnRenamed("doc_key", "a"), "a").select(F.col("b").alias("doc_key"), (F.col("score") * decay).alias("score"), F.col("a").alias("via"))
        best = step.where(F.col("score") >= least).groupBy("doc_key").agg(F.max(F.struct("score", F.lit(-hop).alias("h"))).alias("m"), F.min_by("via", F.struct(-F.col("score"), "via")).alias("via"))
        fresh = best.join(seen, "doc_key", "left_anti").select("doc_key", "m.score", F.lit(hop).alias("hop"), "via").checkpoint()
        found = found.unionByName(fresh)
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh.select("doc_key")), fresh.select("doc_key", "score")
    return found.orderBy(F.col("score").desc(), "doc_key").limit(most)


def related_pages(graph: DataFrame, most: int = 8) -> DataFrame:
    """For each page up to `most` linked pages by key with the direction in, out or both: (doc_key, related, direction)."""
    out = graph.select(F.col("source_doc").alias("doc_key"), F.col("target_doc").alias("related"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    back = graph.select(F.col("target_doc").alias("doc_key"), F.col("source_doc").alias("related"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    both = out.unionByName(back).groupBy("doc_key", "related").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    kind = F.when((F.col("o") == 1) & (F.col("i") == 1), "both").when(F.col("o") == 1, "out").otherwise("in")
    r = F.row_number().over(Window.partitionBy("doc_key").orderBy("related"))
    return both.select("doc_key", "related", kind.alias("direction"), r.alias("r")).where(F.col("r") <= most).drop("r")


def overview_refs(pages: DataFrame, affected: DataFrame) -> DataFrame:
    """Affected modules that an overview page links to: (doc_key, module); such overviews are stale."""
    low = F.lower("module")
    refs = page_links(pages.where(F.lower("doc_key").rlike(r"(^|/)overview\.md$")))
    stem = F.lower(F.regexp_replace(F.regexp_extract("target", r"([^/]*)$", 1), r"\.md$", ""))
    return refs.select(F.col("source_doc").alias("doc_key"), stem.alias("m")).distinct().join(affected.select("module", F.regexp_replace(low, r"[\s/]+", "_").alias("m")), "m").select("doc_key", "module")
