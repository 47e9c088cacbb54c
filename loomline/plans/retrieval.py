"""Retrieval and wiki queries over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import scalar as S
from loomline.operators import links, retrieval
from loomline.plans import sqlbits as q
from loomline.sources.files import pages_of_documents
from loomline.sources.tables import table

QUERY = "loader falls back to the value stored by the nested channel worker"
WORDS = ("loader", "value", "channel", "timeout")
SYNONYMS = [("cache", "cache"), ("cache", "value stored"), ("cache", "Buffer"), ("queue", "queue"), ("queue", "dead letter"), ("loader", "Loader"), ("loader", "importer")]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), "text", "source", "lang", "doc_id", F.col("doc_key").alias("path"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return pages_of_documents(table(spark, d, "documents"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best documents of a query."""
    best = retrieval.top(retrieval.scan_search(_docs(spark, d), retrieval.query_terms(QUERY, spark=spark)), 20)
    return best.select("doc_key", F.round("score", 4).alias("score"))


def bm25_scope(spark: SparkSession, d: str) -> DataFrame:
    """All scores of a query within note pages of one folder."""
    docs = _docs(spark, d)
    posts, lengths = retrieval.postings(docs, boosted=False), retrieval.doc_lengths(docs, boosted=False)
    keep = docs.where(retrieval.in_scope("path", "notes/decision") & F.col("source").startswith("notes-"))
    found = retrieval.bm25(posts, lengths, retrieval.query_terms(QUERY, spark=spark), keep=keep)
    return found.select("doc_key", F.round("score", 4).alias("score"))


def bm25_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Pages with boosted fields, the query expanded by synonyms."""
    pages = _pages(spark, d)
    terms = retrieval.query_terms("cache queue", ("stale entries",), spark.createDataFrame(SYNONYMS, "group_id string, member string"), spark)
    best = retrieval.top(retrieval.bm25(retrieval.postings(pages), retrieval.doc_lengths(pages), terms), 20)
    return best.select("doc_key", F.round("score", 4).alias("score"))


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Visible results with trust, label and snippet; superseded pages at half score."""
    pages = _pages(spark, d).withColumn("status", S.front_matter_value("text", "status")).withColumn("superseded_by", S.front_matter_value("text", "superseded_by")).withColumn("verified_by", S.front_matter_list("text", "verified_by"))
    scored = retrieval.bm25(retrieval.postings(pages), retrieval.doc_lengths(pages), retrieval.query_terms(QUERY, spark=spark))
    found = retrieval.post_process(scored, pages, 20).withColumn("score", F.round("score", 4))
    return retrieval.with_snippets(found, pages, list(WORDS))


def postings_df(spark: SparkSession, d: str) -> DataFrame:
    """A4, A5: the number of documents and occurrences of each term."""
    p = retrieval.postings(_docs(spark, d), boosted=False)
    return p.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their average length in terms."""
    return retrieval.corpus_stats(retrieval.doc_lengths(_docs(spark, d), boosted=False)).select("total_docs", F.round("avg_doc_len", 6).alias("avg_doc_len"))


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The terms of an expanded query and how many documents hold each."""
    terms = retrieval.query_terms("cache queue cache", ("loader timeout",), spark.createDataFrame(SYNONYMS, "group_id string, member string"), spark)
    df = retrieval.doc_frequencies(retrieval.postings(_docs(spark, d), boosted=False))
    return terms.join(df, "token", "left").select("token", "times", F.coalesce("df", F.lit(0)).alias("df"))


def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    """The plain keyword score of every document above the threshold."""
    rows = _docs(spark, d).select("doc_key", retrieval.keyword_score("text", WORDS).alias("score"))
    return rows.where("score > 0.05").select("doc_key", F.round("score", 6).alias("score"))


def snippet_best_line(spark: SparkSession, d: str) -> DataFrame:
    """The snippet of every document for some words."""
    terms = F.array(*(F.lit(w) for w in WORDS))
    from loomline.functions.text import snippet

    return _docs(spark, d).where("text is not null").select("doc_key", F.md5(snippet("text", terms)).alias("snippet_md5"))


def page_overview(spark: SparkSession, d: str) -> DataFrame:
    """Pages by how many words their title and description hold."""
    pages = _pages(spark, d).withColumn("tags", S.front_matter_list("text", "tags"))
    return retrieval.overview(pages, ["channel", "ledger"], 20)


def page_directory(spark: SparkSession, d: str) -> DataFrame:
    """Pages by words in their beginning, with their headings."""
    return retrieval.directory(_pages(spark, d), ["channel", "ledger", "queue"], k=20).select("doc_key", "overlap", F.size("headings").alias("n_headings"))


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section titled like "design" of every page that has one."""
    s = retrieval.section("text", "design")
    return _pages(spark, d).select("doc_key", F.length(s).alias("n_chars"), F.md5(s).alias("md5")).where("md5 is not null")


def titles(spark: SparkSession, d: str) -> DataFrame:
    """The title and summary of every page."""
    return _pages(spark, d).select("doc_key", S.extract_title("text").alias("title"), S.summary("text").alias("summary"))


def front_matter_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the front matter, the status in the present words, and whether a page expired."""
    p = _pages(spark, d).select("doc_key", "text", S.front_matter_value("text", "status").alias("s"), S.front_matter_value("text", "type").alias("type"), S.front_matter_value("text", "stale_after").alias("stale_after"))
    return p.select("doc_key", "type", S.norm_status("s").alias("status"), "stale_after", S.is_stale("stale_after", F.lit("2025-10-01")).alias("expired"))


def link_graph(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links between existing pages."""
    return links.link_graph(_pages(spark, d))


def related_pages(spark: SparkSession, d: str) -> DataFrame:
    """Up to eight linked pages of each page with the direction."""
    return links.related_pages(links.link_graph(_pages(spark, d)))


def link_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Pages within two hops of the best results."""
    pages = _pages(spark, d)
    seeds = retrieval.top(retrieval.bm25(retrieval.postings(pages), retrieval.doc_lengths(pages), retrieval.query_terms(QUERY, spark=spark)), 10)
    return links.expand(links.link_graph(pages), seeds, 2).select("doc_key", F.round("score", 4).alias("score"), "hop")


def broken_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that lead to no page."""
    return links.broken_links(_pages(spark, d))


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_scope, bm25_boosted, search_results, postings_df, corpus_stats, query_expansion, keyword_score, snippet_best_line, page_overview,
    page_directory, page_sections, titles, front_matter_fields, link_graph, related_pages, link_expansion, broken_links,
)}

_INDEX = f"""
post AS (SELECT doc_key, path, source, token, count(*) AS tf FROM (
  SELECT CAST(doc_id AS VARCHAR) AS doc_key, doc_key AS path, source, unnest({q.tokens('text')}) AS token FROM documents) GROUP BY ALL),
len AS (SELECT CAST(doc_id AS VARCHAR) AS doc_key, len({q.tokens('text')}) AS n FROM documents),
st AS (SELECT count(*) AS nd, avg(n) AS av FROM len),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qt AS (SELECT token, count(*) AS times FROM (SELECT unnest({q.tokens(f"'{QUERY}'")}) AS token) GROUP BY token),
sc AS (SELECT p.doc_key, p.path, p.source,
  sum(greatest(0.0, ln((st.nd - df.df + 0.5) / (df.df + 0.5) + 1.0)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len.n / st.av)) * qt.times) AS score
  FROM post p JOIN qt USING (token) JOIN df USING (token) JOIN len USING (doc_key), st GROUP BY ALL)
"""
_BOOSTED = f"SELECT doc_key, {q.tokens(q.indexable('text'))} AS toks FROM pages"
_ASKED = f"SELECT token, count(*) AS times FROM (SELECT unnest({q.tokens(f"'{QUERY}'")}) AS token) GROUP BY token"
_W = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_HITS = " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) / {len(w)}.0" for w in WORDS)
_FOUND = " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in WORDS)
_BODY = q.without_fm("coalesce(text, '')")
_SYN = ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS)

SQL = {
    "bm25_topk": f"WITH {_INDEX} SELECT doc_key, round(score, 4) AS score FROM sc WHERE score >= 0.1 ORDER BY sc.score DESC, doc_key LIMIT 20",
    "bm25_scope": f"""WITH {_INDEX} SELECT doc_key, round(score, 4) AS score FROM sc WHERE score >= 0.1 AND starts_with(source, 'notes-')
        AND ({q.stem('path')} = 'notes/decision' OR starts_with(lower(path), 'notes/decision/') OR contains(lower(path), '/notes/decision/'))""",
    "bm25_boosted": f"""WITH {q.PAGES}, syn AS (SELECT g, unnest({q.tokens('m')}) AS token FROM (VALUES {_SYN}) t(g, m)),
        {q.ranked('sc', _BOOSTED, """SELECT token, 1 AS times FROM (SELECT unnest(['cache', 'queue', 'stale', 'entries']) AS token UNION SELECT token FROM syn WHERE g IN (SELECT g FROM syn WHERE token IN ('cache', 'queue')))""")}
        SELECT doc_key, round(score, 4) AS score FROM sc ORDER BY sc.score DESC, doc_key LIMIT 20""",
    "search_results": f"""WITH {q.PAGES}, {q.ranked('sc', _BOOSTED, _ASKED)},
        p AS (SELECT doc_key, text, {q.fm_value('text', 'status')} AS s, {q.fm_value('text', 'superseded_by')} AS superseded, {q.listed(q.fm_text('text'), 'verified_by')} AS v FROM pages),
        n AS (SELECT *, CASE WHEN s IS NULL THEN 'stable' WHEN lower(s) = 'candidate' THEN 'draft' WHEN lower(s) = 'confirmed' THEN 'stable' WHEN lower(s) IN ('rejected', 'superseded') THEN 'deprecated' ELSE lower(s) END AS status FROM p),
        best AS (SELECT sc.doc_key, score * CASE WHEN superseded IS NOT NULL THEN 0.5 ELSE 1.0 END AS score, status, CASE WHEN status = 'draft' THEN '[unconfirmed]' ELSE '' END AS label,
          CASE WHEN coalesce(len(v), 0) = 0 THEN 'unverified' WHEN len(list_filter(v, lambda x: starts_with(x, 'human:'))) > 0 THEN 'human-reviewed' ELSE 'machine-confirmed' END AS trust, text
          FROM sc JOIN n USING (doc_key) WHERE status <> 'deprecated' ORDER BY 2 DESC, 1 LIMIT 20),
        l AS (SELECT *, {q.lines(q.without_fm('text'))} AS ls FROM best), c AS (SELECT *, list_transform(ls, lambda x: len(list_filter({_W}, lambda t: contains(lower(x), t)))) AS cs FROM l),
        b AS (SELECT *, list_position(cs, list_max(cs)) AS pos FROM c)
        SELECT doc_key, round(score, 4) AS score, status, label, trust, substr(trim(array_to_string(list_slice(ls, greatest(pos - 1, 1), pos + 2), chr(10))), 1, 300) AS snippet FROM b""",
    "page_overview": f"""WITH {q.PAGES}, b AS (SELECT doc_key, coalesce({q.title('text')}, title) AS title, array_to_string({q.listed(q.fm_text('text'), 'tags')}, ' ') AS tags,
          trim(coalesce(list_filter({q.lines(q.without_fm('text'))}, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(?:#|>|\\||```|---|!\\[|<!--|[-*] )'))[1], '')) AS f FROM pages),
        d AS (SELECT doc_key, title, tags, CASE WHEN length(f) > 120 THEN substr(f, 1, 117) || '...' ELSE f END AS description FROM b),
        n AS (SELECT *, lower(concat_ws(' ', title, description, tags)) AS low FROM d)
        SELECT * FROM (SELECT doc_key, title, description, CASE WHEN contains(low, 'channel') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'ledger') THEN 1 ELSE 0 END AS overlap FROM n) WHERE overlap > 0 ORDER BY overlap DESC, doc_key LIMIT 20""",
    "page_sections": f"""WITH {q.PAGES}, l AS (SELECT doc_key, {q.lines('text')} AS ls FROM pages), v AS (SELECT doc_key, ls, list_transform(ls, lambda x: length(regexp_extract(x, '^(#{{1,6}})\\s', 1))) AS lv FROM l),
        h AS (SELECT doc_key, ls, lv, list_position(list_transform(ls, lambda x: regexp_matches(x, '^#{{1,6}}\\s') AND contains(lower(x), 'design')), true) AS pos FROM v),
        e AS (SELECT doc_key, ls, pos, list_position(list_transform(list_slice(lv, pos + 1, len(lv)), lambda n: n > 0 AND n <= lv[pos]), true) AS after FROM h WHERE pos > 0),
        s AS (SELECT doc_key, substr(array_to_string(list_slice(ls, pos, CASE WHEN after > 0 THEN pos + after - 1 ELSE len(ls) END), chr(10)), 1, 5000) AS s FROM e)
        SELECT doc_key, length(s) AS n_chars, md5(s) AS md5 FROM s""",
    "link_expansion": f"""WITH {q.PAGES}, {q.LINK_GRAPH}, {q.ranked('sc', _BOOSTED, _ASKED)},
        seeds AS (SELECT doc_key, score FROM sc ORDER BY score DESC, doc_key LIMIT 10), near AS (SELECT source_doc AS a, target_doc AS b FROM links UNION SELECT target_doc, source_doc FROM links),
        h1 AS (SELECT b AS doc_key, max(score * 0.5) AS score, 1 AS hop FROM near JOIN seeds ON doc_key = a WHERE score * 0.5 >= 0.05 AND b NOT IN (SELECT doc_key FROM seeds) GROUP BY b),
        h2 AS (SELECT b AS doc_key, max(score * 0.5) AS score, 2 AS hop FROM near JOIN h1 ON doc_key = a WHERE score * 0.5 >= 0.05 AND b NOT IN (SELECT doc_key FROM seeds UNION SELECT doc_key FROM h1) GROUP BY b)
        SELECT doc_key, round(score, 4) AS score, hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) x ORDER BY x.score DESC, doc_key LIMIT 30""",
    "postings_df": f"SELECT token, count(*) AS df, sum(tf) AS occurrences FROM (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({q.tokens('text')}) AS token FROM documents) GROUP BY ALL) GROUP BY token",
    "corpus_stats": f"SELECT count(*) AS total_docs, round(avg(len({q.tokens('text')})), 6) AS avg_doc_len FROM documents",
    "query_expansion": f"""
        WITH own AS (SELECT token, count(*) AS times FROM (SELECT unnest({q.tokens("'cache queue cache'")}) AS token) GROUP BY token),
        syn AS (SELECT g, unnest({q.tokens('m')}) AS token FROM (VALUES {_SYN}) t(g, m)),
        more AS (SELECT unnest({q.tokens("'loader timeout'")}) AS token UNION SELECT token FROM syn WHERE g IN (SELECT g FROM syn WHERE token IN (SELECT token FROM own))),
        every AS (SELECT token, times FROM own UNION ALL SELECT token, 1 FROM more WHERE token NOT IN (SELECT token FROM own)),
        df AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({q.tokens('text')}) AS token FROM documents) GROUP BY token)
        SELECT token, times, coalesce(df, 0) AS df FROM every LEFT JOIN df USING (token)""",
    "keyword_score": f"""
        SELECT doc_key, round(score, 6) AS score FROM (
          SELECT doc_key, CASE WHEN found > 0 THEN found / {len(WORDS)}.0 * 0.6 + least(hits / 10.0, 1.0) * 0.3 + least(50.0 / n, 1.0) * 0.1 ELSE 0.0 END AS score FROM (
            SELECT CAST(doc_id AS VARCHAR) AS doc_key, {_FOUND} AS found, CAST({_HITS} AS DOUBLE) AS hits, len(string_split(low, chr(10))) AS n
            FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents))) WHERE score > 0.05""",
    "snippet_best_line": f"""
        WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_key, {q.lines(_BODY)} AS ls FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_key, ls, list_transform(ls, lambda x: len(list_filter({_W}, lambda t: contains(lower(x), t)))) AS cs FROM l),
        b AS (SELECT doc_key, ls, list_position(cs, list_max(cs)) AS best FROM c)
        SELECT doc_key, md5(substr(trim(array_to_string(list_slice(ls, greatest(best - 1, 1), best + 2), chr(10))), 1, 300)) AS snippet_md5 FROM b""",
    "page_directory": f"""
        WITH {q.PAGES}, p AS (SELECT doc_key, text, lower(left(text, 3000)) AS low FROM pages),
        n AS (SELECT doc_key, CASE WHEN contains(low, 'channel') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'ledger') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'queue') THEN 1 ELSE 0 END AS overlap,
          len(regexp_extract_all(text, '(?m)^(#{{1,6}} [^\\r\\n]+)', 1)) AS n_headings FROM p) SELECT doc_key, overlap, n_headings FROM n WHERE overlap > 0 ORDER BY overlap DESC, doc_key LIMIT 20""",
    "titles": f"""
        WITH {q.PAGES}, b AS (SELECT doc_key, text, list_filter({q.lines(q.without_fm('text'))}, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(?:#|>|\\||```|---|!\\[|<!--|[-*] )'))[1] AS f FROM pages)
        SELECT doc_key, {q.title('text')} AS title, CASE WHEN length(trim(coalesce(f, ''))) > 120 THEN substr(trim(f), 1, 117) || '...' ELSE trim(coalesce(f, '')) END AS summary FROM b""",
    "front_matter_fields": f"""
        WITH {q.PAGES}, f AS (SELECT doc_key, {q.fm_value('text', 'status')} AS s, {q.fm_value('text', 'type')} AS type, {q.fm_value('text', 'stale_after')} AS stale_after FROM pages)
        SELECT doc_key, type, CASE WHEN s IS NULL THEN 'draft' WHEN lower(s) = 'candidate' THEN 'draft' WHEN lower(s) = 'confirmed' THEN 'stable' WHEN lower(s) IN ('rejected', 'superseded') THEN 'deprecated' ELSE lower(s) END AS status,
          stale_after, coalesce(try_cast(left(stale_after, 10) AS DATE) < DATE '2025-10-01', false) AS expired FROM f""",
    "link_graph": f"WITH {q.PAGES}, {q.LINK_GRAPH} SELECT * FROM links",
    "related_pages": f"""
        WITH {q.PAGES}, {q.LINK_GRAPH}, u AS (
          SELECT doc_key, related, max(o) AS o, max(i) AS i FROM (
            SELECT source_doc AS doc_key, target_doc AS related, 1 AS o, 0 AS i FROM links UNION ALL SELECT target_doc, source_doc, 0, 1 FROM links) GROUP BY ALL)
        SELECT doc_key, related, CASE WHEN o = 1 AND i = 1 THEN 'both' WHEN o = 1 THEN 'out' ELSE 'in' END AS direction
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY related) AS n FROM u) WHERE n <= 8""",
    "broken_links": f"""
        WITH {q.PAGES}, {q.LINK_GRAPH}
        SELECT source_doc, target, 'wikilink' AS link_type FROM wl WHERE target NOT IN (SELECT target FROM wres)
        UNION ALL SELECT source_doc, target, 'markdown' FROM mkeys WHERE doc_key IS NULL""",
}
