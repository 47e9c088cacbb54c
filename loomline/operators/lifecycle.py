"""Counters, issues, notes and sources that live: their state as a function of their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.scalar import front_matter, issue_id, norm_status, stale_date
from loomline.operators.skew import salted_join


def retrieval_stats(hits: DataFrame) -> DataFrame:
    """Per file: hit_count, last_query (of the latest hit, ties by text), first_hit, last_hit; `hits` are (file_path, query, at)."""
    return hits.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("hit_count"), F.max_by("query", F.struct("at", "query")).alias("last_query"),
        F.to_date(F.min("at")).alias("first_hit"), F.to_date(F.max("at")).alias("last_hit"),
    )


def add_hits(stats: DataFrame, hits: DataFrame) -> DataFrame:
    """Counters after more hits: counts add up, the first hit stays, the last one moves."""
    both = stats.unionByName(retrieval_stats(hits))
    return both.groupBy("file_path").agg(
        F.sum("hit_count").alias("hit_count"), F.max_by("last_query", F.struct("last_hit", "last_query")).alias("last_query"),
        F.min("first_hit").alias("first_hit"), F.max("last_hit").alias("last_hit"),
    )


STATS_ORDERS = ("hit_count", "last_hit", "first_hit", "file_path")


def rank_stats(stats: DataFrame, by: str = "hit_count", ascending: bool = False, least: int = 0, most: int = 50) -> DataFrame:
    """Counters in a chosen order, 1 to 200 rows with at least `least` hits; ties by file."""
    if by not in STATS_ORDERS:
        raise ValueError(f"order by one of {STATS_ORDERS}")
    key = F.col(by).asc() if ascending else F.col(by).desc()
    return stats.where(F.col("hit_count") >= least).orderBy(key, "file_path").limit(max(1, min(200, most)))


def hit_summary(hits: DataFrame, files: DataFrame) -> DataFrame:
    """One row: distinct queries, files hit, all files, and the share hit."""
    hit = hits.select("file_path").distinct().withColumn("h", F.lit(1.0))
    n = files.select("file_path").distinct().join(hit, "file_path", "left").select(F.lit(None).cast("string").alias("query"), F.coalesce("h", F.lit(0.0)).alias("h"))
    both = n.unionByName(hits.select(F.col("query").cast("string").alias("query"), F.lit(None).cast("double").alias("h")).distinct())
    return both.agg(F.count_distinct("query").alias("n_queries"), F.count("h").alias("n_files"), F.count_if(F.col("h") == 1).alias("n_hit"), F.round(F.avg("h"), 6).alias("hit_rate"))


def zero_hits(files: DataFrame, stats: DataFrame) -> DataFrame:
    """Files no search hit, against all counters (not only the reported ones)."""
    return files.select("file_path").distinct().join(stats.select("file_path").distinct(), "file_path", "left_anti")


def flag_issues(flags: DataFrame) -> DataFrame:
    """Issues by their stable id: (issue_id, issue_type, page_path, occurrences, first_seen, last_seen, descriptions).

    `flags` are (issue_type, page_path, description, at). Descriptions are the distinct texts in the order of their
    first mention; equal texts are made one before they are gathered, so repeats do not grow the list.
    """
    one = flags.groupBy("issue_type", "page_path", "description").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    said = F.array_sort(F.collect_list(F.when(F.col("description").isNotNull(), F.struct("first", "description"))))
    rows = one.groupBy("issue_type", "page_path").agg(F.sum("n").alias("occurrences"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), said["description"].alias("descriptions"))
    return rows.select(issue_id("issue_type", "page_path").alias("issue_id"), "*")


def note_states(events: DataFrame) -> DataFrame:
    """The present state of notes from their events (note, at, status, by, reason):
    (note, status, reason, verified_by, superseded): the last status holds, confirmations are listed in order."""
    ok = F.when(norm_status("status") == "stable", F.struct("at", F.coalesce("by", F.lit("machine")).alias("by")))
    rows = events.groupBy("note").agg(
        F.max_by(F.struct(norm_status("status").alias("status"), "reason"), F.struct("at", "status")).alias("s"),
        F.array_sort(F.collect_set(ok)).alias("v"),
    )
    return rows.select("note", "s.status", "s.reason", F.col("v.by").alias("verified_by"))


def ingest_sources(arrivals: DataFrame, retractions: DataFrame | None = None, remove: bool = False) -> DataFrame:
    """Sources by content: (name, content_hash, added_at, status). The first arrival of a content counts, later ones are
    repeats; retracted names are marked, or left out if `remove`."""
    first = arrivals.groupBy("content_hash").agg(F.min(F.struct("at", "name")).alias("f")).select(F.col("f.name").alias("name"), "content_hash", F.col("f.at").alias("added_at"))
    if retractions is None:
        return first.withColumn("status", F.lit("active"))
    gone = retractions.select("name").distinct()
    if remove:
        return first.join(gone, "name", "left_anti").withColumn("status", F.lit("active"))
    return first.join(gone.withColumn("g", F.lit(True)), "name", "left").select("name", "content_hash", "added_at", F.when(F.col("g"), "retracted").otherwise("active").alias("status"))


def batch_ingest(items: DataFrame) -> DataFrame:
    """Each item of a batch with what became of it: (item, kind, status, error). Kinds are note and source; a note needs
    a title and content, a source content; contents that came before in the batch are repeats."""
    body = F.trim(F.coalesce("content", F.lit("")))
    error = (
        F.when(~F.coalesce(F.col("kind").isin("note", "source"), F.lit(False)), "unknown kind")
        .when(body == "", "no content")
        .when((F.col("kind") == "note") & (F.trim(F.coalesce("title", F.lit(""))) == ""), "no title")
    )
    # failed items have no hash and so meet no other; contents that often repeat are salted
    rows = items.withColumn("error", error).select("item", "kind", "error", F.when(F.col("error").isNull(), F.sha2("content", 256)).alias("h"))
    first = rows.where("error is null").groupBy("h", "kind").agg(F.min("item").alias("first"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("item") == F.col("first"), "ingested").otherwise("repeat")
    return salted_join(rows, first, ["h", "kind"], "left", spread=["item"]).select("item", "kind", status.alias("status"), "error")


def migrate(pages: DataFrame, today: str, days: int = 90) -> DataFrame:
    """Pages with the front matter they lacked: (doc_key, text, changed). Type by folder, status stable, stale_after from
    today; pages that have front matter with a type stay, so a second run changes nothing."""
    kind = (
        F.when(F.lower("doc_key").contains("notes/"), "note").when(F.lower("doc_key").contains("raw/sources"), "source")
        .when(F.lower("doc_key").contains("/entities/"), "entity").when(F.lower("doc_key").contains("/concepts/"), "concept").otherwise("module")
    )
    fm = front_matter("text")
    head = F.concat(F.lit("type: "), kind, F.lit("\nstatus: stable\nstale_after: "), stale_date(F.lit(today), days).cast("string"))
    lacks = ~fm.rlike(r"(?m)^type:\s*\S")
    text = F.when(~lacks, F.col("text")).when(fm == "", F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.coalesce("text", F.lit("")))).otherwise(
        F.concat(F.lit("---\ntype: "), kind, F.lit("\n"), F.regexp_replace("text", r"\A\x{FEFF}?---\r?\n", ""))
    )
    return pages.select("doc_key", text.alias("text"), lacks.alias("changed"))


def sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "2 hours") -> DataFrame:
    """Sessions of each user: (user, started, ended, n_events). An event belongs to the session before if it follows
    within the gap, the gap's end included."""
    w = F.session_window(F.col(at), gap)
    return events.where(F.col(user).isNotNull() & F.col(at).isNotNull()).groupBy(user, w.alias("w")).agg(
        F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n_events")
    ).drop("w")


def kept_sessions(events: DataFrame, capacity: int = 10, user: str = "user_id", at: str = "ts") -> DataFrame:
    """The `capacity` users that were seen last, which a store of that size keeps: (user, last_access); ties by user."""
    last = events.groupBy(user).agg(F.max(at).alias("last_access"))
    return last.orderBy(F.col("last_access").desc(), user).limit(capacity)


def expired(entries: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Entries older than `days` at a time."""
    return entries.where(F.col(at) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def history(edits: DataFrame, most: int = 20, key: str = "doc_key", at: str = "at") -> DataFrame:
    """The last `most` edits of each page."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc()))
    return edits.withColumn("r", r).where(F.col("r") <= most).drop("r")
