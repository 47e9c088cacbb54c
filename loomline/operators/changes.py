"""Change detection, upserts and deletions: set operations over keyed tables.

Tables are never changed in place: each operator gives the new contents, which a sink writes in one piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.ids import clean_path


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order` (null keys are one key); combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, F.hash(*rest)))
    return rows.groupBy(*keys).agg(best.alias("__r")).select(*(F.col(c) if c in keys else F.col(f"__r.{c}") for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those of the same key, and `new`'s own."""
    kept = old.alias("o").join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def upsert_edges(old: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges after some sources were parsed again: all edges of `sources` (column id) are replaced."""
    return old.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select("src", "dst").unionByName(new.select("src", "dst")).distinct()


def upsert_routes(old: DataFrame, new: DataFrame, incremental: bool) -> DataFrame:
    """Routes after a run: replaced, or merged if `incremental`; a run without routes changes nothing."""
    if new.isEmpty():
        return old
    return upsert(old, new, ["route_key", "component_id", "role"]) if incremental else new


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` and those rows of `new` whose key is not there yet, one of each key."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def component_changes(old: DataFrame, new: DataFrame, key: str = "id", value: str = "content_hash") -> DataFrame:
    """(key, change): added, modified or deleted between two states; repeated keys count once by their least value."""
    a = old.groupBy(key).agg(F.min(value).alias("__a"), F.lit(1).alias("__in_a"))
    b = new.groupBy(key).agg(F.min(value).alias("__b"), F.lit(1).alias("__in_b"))
    kind = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "modified")
    return a.join(b, key, "full").select(key, kind.alias("change")).where("change is not null")


def file_changes(old: DataFrame, new: DataFrame, slack: float = 1.0) -> DataFrame:
    """(file_path, change): new, vanished or changed files by fingerprint; changed means another size, another hash
    (where both have one) or an mtime that differs by more than `slack` seconds (where a hash is missing)."""
    cols = ["mtime", "size", "content_hash"]
    a = old.groupBy("file_path").agg(F.max_by(F.struct(*cols), "mtime").alias("a"))
    b = new.groupBy("file_path").agg(F.max_by(F.struct(*cols), "mtime").alias("b"))
    hashes = F.col("a.content_hash").isNotNull() & F.col("b.content_hash").isNotNull()
    differs = ~F.col("a.size").eqNullSafe(F.col("b.size")) | F.when(hashes, F.col("a.content_hash") != F.col("b.content_hash")).otherwise(
        F.coalesce(F.abs(F.col("a.mtime") - F.col("b.mtime")) > slack, F.lit(False))
    )
    kind = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "vanished").when(differs, "changed")
    return a.join(b, "file_path", "full").select("file_path", kind.alias("change")).where("change is not null")


def listed_changes(*lists: DataFrame, subpath: str = "") -> DataFrame:
    """The distinct files of several lists (committed, staged, unstaged, untracked), without the subpath they lie under."""
    out = lists[0].select("file")
    for x in lists[1:]:
        out = out.unionByName(x.select("file"))
    p = clean_path("file")
    if subpath:
        under = subpath.strip("/") + "/"
        return out.where(p.startswith(under)).select(F.substring(p, len(under) + 1, 100_000).alias("file")).distinct()
    return out.select(p.alias("file")).where("file <> ''").distinct()


def modified_since(files: DataFrame, since: float) -> DataFrame:
    """Files with an mtime after the last run."""
    return files.where(F.col("mtime") > since).select("file_path").distinct()


def remove_files(components: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components and edges after files went: a component goes if its path is a file's, written either way, or ends in
    `/` and a file that has a folder; edges go with either end."""
    f = files.select(clean_path("file").alias("p")).distinct()
    c = components.withColumn("__p", clean_path("relative_path"))
    parts = F.split("__p", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tried = c.select("id", "__p", F.explode(tails).alias("p")).where((F.col("p") == F.col("__p")) | F.col("p").contains("/"))
    gone = tried.join(f, "p").select("id").distinct()
    kept = components.join(gone, "id", "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept.select(*components.columns), e.select(*edges.columns)


def remove_routes(routes: DataFrame, files: DataFrame) -> DataFrame:
    """Routes without those of some files, written either way."""
    f = files.select(clean_path("file").alias("__p")).distinct()
    return routes.withColumn("__p", clean_path("file_path")).join(f, "__p", "left_anti").select(*routes.columns)


def minus(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key stands in no row of `other`."""
    return rows.join(other.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)


def documented(components: DataFrame, listed: DataFrame) -> DataFrame:
    """Ids of components that a module lists."""
    return components.select("id").distinct().join(listed.select(F.col("component_id").alias("id")).distinct(), "id", "left_semi")


def without_nested(services: DataFrame) -> DataFrame:
    """The rows of services whose folder lies in no other service's folder; `relative_path` in clean notation."""
    s = services.withColumn("relative_path", clean_path("relative_path")).distinct()
    parts = F.split("relative_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inner = s.select("relative_path", F.explode(above).alias("q")).where("relative_path <> q")
    inner = inner.join(s.select(F.col("relative_path").alias("q")), "q", "left_semi").select("relative_path")
    return s.join(inner, "relative_path", "left_anti").select(*services.columns)
