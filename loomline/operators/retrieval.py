"""Full-text retrieval: postings, BM25, expansion, snippets and what follows a search.

Pages are rows (doc_key, source, title, text, ...). The index is three tables: postings (token, doc_key, tf), document
lengths (doc_key, doc_len) and document frequencies (token, df).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.scalar import col, extract_title, norm_status, summary, trust_tier
from loomline.functions.text import indexable_text, snippet, tokens
from loomline.operators.skew import spread

K1, B = 1.5, 0.75
#: Query terms that are broadcast; more are joined.
MOST_TERMS = 10_000


def postings(pages: DataFrame, key: str = "doc_key", text: str = "text", boosted: bool = True) -> DataFrame:
    """(token, doc_key, tf): how often each term stands in each page. Empty pages give no rows."""
    body = indexable_text(text) if boosted else col(text)
    return (
        spread(pages).select(F.col(key).alias("doc_key"), F.explode(tokens(body)).alias("token"))
        .groupBy("token", "doc_key")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
    )


def doc_lengths(pages: DataFrame, key: str = "doc_key", text: str = "text", boosted: bool = True) -> DataFrame:
    """(doc_key, doc_len): the number of terms of each page, 0 for empty ones; computed without a shuffle."""
    body = indexable_text(text) if boosted else col(text)
    return spread(pages).select(F.col(key).alias("doc_key"), F.size(tokens(body)).alias("doc_len"))


def doc_frequencies(posts: DataFrame) -> DataFrame:
    """(token, df)."""
    return posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: total_docs, avg_doc_len."""
    return lengths.agg(F.count(F.lit(1)).alias("total_docs"), F.avg("doc_len").alias("avg_doc_len"))


def query_terms(query: str, extra: Sequence[str] = (), synonyms: DataFrame | None = None, spark=None) -> DataFrame:
    """The terms of a query with their number, expanded: (token, times).

    Terms of the query count as often as they stand in it. `extra` phrases add terms that are not there yet, and so do
    the members of each synonym group (rows (group_id, member)) that holds a query term; both are tokenised.
    """
    session = spark or (synonyms.sparkSession if synonyms is not None else None)
    base = session.createDataFrame([(query,)], "q string").select(F.explode(tokens("q")).alias("token"))
    own = base.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    more = session.createDataFrame([(x,) for x in extra], "q string").select(F.explode(tokens("q")).alias("token"))
    if synonyms is not None:
        members = synonyms.select("group_id", F.explode(tokens("member")).alias("token"))
        groups = members.join(own.select("token"), "token", "left_semi").select("group_id").distinct()
        more = more.unionByName(members.join(groups, "group_id", "left_semi").select("token"))
    fresh = more.distinct().join(own, "token", "left_anti").withColumn("times", F.lit(1).cast("long"))
    return own.unionByName(fresh)


def bm25(posts: DataFrame, lengths: DataFrame, terms: DataFrame, least: float = 0.1, keep: DataFrame | None = None) -> DataFrame:
    """(doc_key, score) of the pages that hold a term, with a score of at least `least`.

    k1 = 1.5, b = 0.75, idf = max(0, ln((N - df + 0.5) / (df + 0.5) + 1)); repeated query terms count repeatedly.
    `keep` restricts the pages scored (frequencies still count all). The query's terms are a few rows; postings are
    filtered by them first, so only matching postings are shuffled.
    """
    # the size of the terms is counted before they are broadcast; synonym tables may make them many
    sent = F.broadcast if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else (lambda df: df)
    # the semi join moves below the aggregation that makes the postings, an inner join would not
    hits = posts.join(sent(terms.select("token")), "token", "left_semi").join(sent(terms), "token")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus_stats(lengths).first()
    n, average = int(stats["total_docs"] or 0), float(stats["avg_doc_len"] or 0.0) or 1.0
    if keep is not None:
        hits = hits.join(keep.select("doc_key").distinct(), "doc_key", "left_semi")
    idf = F.greatest(F.lit(0.0), F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    tf = F.col("tf").cast("double")
    gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / average)) * F.col("times")
    scored = hits.join(sent(df), "token").join(lengths, "doc_key").groupBy("doc_key").agg(F.sum(gain).alias("score"))
    return scored.where(F.col("score") >= least)


def scan_search(pages: DataFrame, terms: DataFrame, least: float = 0.1, keep: Column | None = None, key: str = "doc_key", text: str = "text", boosted: bool = False) -> DataFrame:
    """The same scores as `bm25` for pages that have no index: (doc_key, score).

    The query's terms, a few words, are literals. One pass over the pages counts documents, lengths and the pages of
    each term, a second one scores; nothing but the counts is exchanged. Use `bm25` where postings are stored.
    """
    asked = [(r["token"], int(r["times"])) for r in terms.orderBy("token").collect()]
    body = indexable_text(text) if boosted else col(text)
    rows = spread(pages.withColumn("__kept", F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).select(F.col(key).alias("doc_key"), "__kept", F.col(text)))
    rows = rows.select("doc_key", "__kept", tokens(body).alias("t"))
    tf = lambda w: F.size(F.filter("t", lambda x: x == w))
    counts = rows.select("doc_key", "__kept", F.size("t").alias("n"), *(tf(w).alias(f"f{i}") for i, (w, _) in enumerate(asked)))
    got = counts.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("average"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(asked)))).first()
    n, average = got["docs"], float(got["average"] or 0.0) or 1.0
    length = K1 * (1 - B + B * F.col("n") / average)
    score = F.lit(0.0)
    for i, (_, times) in enumerate(asked):
        f = F.col(f"f{i}").cast("double")
        score = score + F.lit(idf(got[f"d{i}"], n) * times) * f * (K1 + 1) / (f + length)
    # a filter on the score would be pushed below the counts, which then run once per mention; a generator is not
    best = F.filter(F.array(score), lambda s: s >= least)
    return counts.where("__kept").select("doc_key", F.explode(best).alias("score"))


def top(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k (1 to 20) best pages; ties by key."""
    return scored.orderBy(F.col("score").desc(), "doc_key").limit(max(1, min(20, k)))


def in_scope(doc_key: Column | str, scope: str) -> Column:
    """Whether a page's stem is the scope, or its path begins with it."""
    low = F.lower(col(doc_key))
    stem = F.regexp_replace(F.regexp_extract(low, r"([^/]*)$", 1), r"\.[^.]*$", "")
    s = scope.lower().strip("/")
    return (stem == s) | low.startswith(s + "/") | low.contains("/" + s + "/") | (low == s)


def of_type(doc_key: Column | str, source: Column | str, kind: str) -> Column:
    """Whether a page is of a type: doc, note or source by its source, any other type by its folder under the wiki."""
    from loomline.functions.scalar import PAGE_TYPE_DIRS

    if kind in ("doc", "note", "source"):
        return col(source) == kind
    return F.lower(col(doc_key)).contains(f"wiki/{PAGE_TYPE_DIRS.get(kind, kind)}/")


def with_snippets(best: DataFrame, pages: DataFrame, words: Sequence[str]) -> DataFrame:
    """The pages found with the snippet around their best line."""
    terms = F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")
    return best.join(pages.select("doc_key", "text"), "doc_key").select(*best.columns, snippet("text", terms).alias("snippet"))


def visible(pages: DataFrame) -> DataFrame:
    """Pages without deprecated ones; `label` marks drafts, a missing status is read as stable."""
    state = F.when(F.col("status").isNull() | (F.col("status") == ""), "stable").otherwise(norm_status("status"))
    return pages.withColumn("status", state).where(F.col("status") != "deprecated").withColumn("label", F.when(F.col("status") == "draft", "[unconfirmed]").otherwise(""))


def post_process(scored: DataFrame, pages: DataFrame, k: int = 10) -> DataFrame:
    """Search results with label and trust: deprecated pages out and superseded ones at half score, both before the best
    k are taken. `pages` has status, superseded_by and verified_by (a list)."""
    seen = visible(pages).select("doc_key", "status", "label", "superseded_by", trust_tier("verified_by").alias("trust"))
    half = F.when(F.col("superseded_by").isNotNull() & (F.col("superseded_by") != ""), 0.5).otherwise(1.0)
    return top(scored.join(seen, "doc_key").select("doc_key", (F.col("score") * half).alias("score"), "status", "label", "trust"), k)


def keyword_score(text: Column | str, words: Sequence[str]) -> Column:
    """The score of the plain keyword scan: coverage 0.6, hits (up to 10) 0.3, shortness 0.1."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    quoted = [w.lower() for w in words]
    hits = [(F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / F.lit(len(w)) for w in quoted]
    found = sum((F.when(h > 0, 1).otherwise(0) for h in hits), F.lit(0))
    lines = F.size(F.split(low, "\n", -1))
    total = sum(hits, F.lit(0.0))
    score = found / F.lit(max(1, len(quoted))) * 0.6 + F.least(total / 10, F.lit(1.0)) * 0.3 + F.least(F.lit(50.0) / lines, F.lit(1.0)) * 0.1
    return F.when(found > 0, score).otherwise(F.lit(0.0))


def keyword_search(pages: DataFrame, words: Sequence[str], least: float = 0.05, k: int = 10) -> DataFrame:
    """The k pages of the best keyword score above `least`."""
    scored = pages.select("doc_key", keyword_score("text", words).alias("score")).where(F.col("score") > least)
    return scored.orderBy(F.col("score").desc(), "doc_key").limit(k)


def overview(pages: DataFrame, words: Sequence[str], k: int = 20) -> DataFrame:
    """Pages by how many words stand in their title, description or tags: (doc_key, title, description, overlap)."""
    fields = F.lower(F.concat_ws(" ", F.coalesce(extract_title("text"), F.col("title")), summary("text"), F.array_join(F.col("tags"), " ")))
    n = sum((F.when(fields.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))
    rows = pages.select("doc_key", F.coalesce(extract_title("text"), F.col("title")).alias("title"), summary("text").alias("description"), n.alias("overlap"))
    return rows.where((F.col("overlap") > 0) if words else F.lit(True)).orderBy(F.col("overlap").desc(), "doc_key").limit(k)


def directory(pages: DataFrame, words: Sequence[str], head: int = 3000, k: int = 10) -> DataFrame:
    """Pages by how many words stand in their first `head` characters, with their headings."""
    low = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, head))
    n = sum((F.when(low.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))
    heads = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^(#{1,6} [^\r\n]+)"), 1)
    return pages.select("doc_key", n.alias("overlap"), heads.alias("headings")).where("overlap > 0").orderBy(F.col("overlap").desc(), "doc_key").limit(k)


def section(text: Column | str, title: str, most: int = 5000) -> Column:
    """The section under the first heading that contains `title`, up to the next heading of the same or a higher level;
    null where there is none."""
    lines = F.split(col(text), r"\r?\n")
    level = F.transform(lines, lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)))
    hit = F.zip_with(lines, level, lambda x, n: (n > 0) & F.lower(x).contains(title.lower()))
    at = F.array_position(hit, True).cast("int")
    own = F.get(level, at - 1)
    rest = F.slice(level, at + 1, F.size(lines))
    ends = F.transform(rest, lambda n: (n > 0) & (n <= own))
    n = F.when(F.array_contains(ends, True), F.array_position(ends, True).cast("int")).otherwise(F.size(lines) - at + 1)
    return F.when(at > 0, F.substring(F.array_join(F.slice(lines, at, n), "\n"), 1, most))


def detail(pages: DataFrame, key: str, title: str | None = None, most: int = 5000) -> DataFrame:
    """A page, or one of its sections, cut at `most` characters."""
    body = F.substring("text", 1, most) if title is None else section("text", title, most)
    return pages.where(F.col("doc_key") == key).select("doc_key", body.alias("content"))


def source_counts(found: DataFrame) -> DataFrame:
    """Results per source."""
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def upsert_documents(posts: DataFrame, lengths: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The index after pages changed or went: postings and lengths of the others stay, statistics follow from them."""
    gone = changed.select("doc_key") if removed is None else changed.select("doc_key").unionByName(removed.select("doc_key"))
    gone = gone.distinct()
    return (
        posts.join(gone, "doc_key", "left_anti").unionByName(postings(changed)),
        lengths.join(gone, "doc_key", "left_anti").unionByName(doc_lengths(changed)),
    )


def idf(df: int, n: int) -> float:
    """The inverse document frequency used by `bm25`."""
    return max(0.0, math.log((n - df + 0.5) / (df + 0.5) + 1))


def first_per(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")
