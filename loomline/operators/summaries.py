"""Aggregates and reports over components, files and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.ids import clean_path, is_blank
from loomline.functions.scalar import clean_language, col

kind = lambda: F.lower(F.trim(F.when(~is_blank("component_type"), F.col("component_type")).otherwise(F.col("node_type"))))


def component_count(components: DataFrame) -> DataFrame:
    """One row: the number of distinct component ids."""
    return components.agg(F.count_distinct("id").alias("n_components"))


def list_components(components: DataFrame, prefix: str | None = None, component_type: str | None = None, leaves: DataFrame | None = None) -> DataFrame:
    """Components (id, type, file) by file prefix, type and membership in `leaves`, in the order of file and id."""
    rows = components.select("id", kind().alias("type"), clean_path("relative_path").alias("file")).distinct()
    if prefix is not None:
        rows = rows.where(F.col("file").startswith(prefix))
    if component_type is not None:
        rows = rows.where(F.col("type") == component_type.lower())
    if leaves is not None:
        rows = rows.join(leaves.select("id").distinct(), "id", "left_semi")
    return rows.orderBy("file", "id").select("id", "type", "file")


def file_summary(components: DataFrame) -> DataFrame:
    """Per file the number of components, of each type, and the class names: (file, n, types, classes)."""
    rows = components.select("id", clean_path("relative_path").alias("file"), kind().alias("type"), "name").dropDuplicates(["id"])
    typed = rows.groupBy("file", "type").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("type").isin("class", "struct", "interface"), F.col("name"))).alias("c"))
    entry = F.struct(F.coalesce("type", F.lit("unknown")), F.col("n"))
    return typed.groupBy("file").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("types"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("classes")
    )


def language_counts(rows: DataFrame, column: str = "language") -> DataFrame:
    """Rows per language; null, blank and words for unknown are `unknown`."""
    return rows.groupBy(clean_language(column).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def file_totals(files: DataFrame) -> DataFrame:
    """One row: the number of files and their total size in KB; unknown sizes count 0."""
    f = files.select("relative_path", "size").distinct()
    return f.agg(F.count(F.lit(1)).alias("n_files"), F.round(F.coalesce(F.sum("size"), F.lit(0)) / 1024, 3).alias("total_kb"))


def coverage(components: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: components, those a module lists, and their share in percent."""
    have = components.select("id").distinct().join(listed.select(F.col("component_id").alias("id")).distinct().withColumn("d", F.lit(1)), "id", "left")
    return have.agg(F.count(F.lit(1)).alias("total"), F.count("d").alias("documented"), F.round(F.avg(F.coalesce("d", F.lit(0)).cast("double")) * 100, 2).alias("percent"))


def coverage_by_group(components: DataFrame, group: str, has: Column) -> DataFrame:
    """Per group the share of components with a property, for groups below half: (group, total, documented, percent)."""
    rows = components.dropDuplicates(["id"]).groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("documented"))
    return rows.withColumn("percent", F.round(F.col("documented") / F.col("total") * 100, 2)).where("percent < 50")


def naming_convention(names: DataFrame, column: str = "name") -> DataFrame:
    """One row: the commonest naming style of names, ties by style."""
    n = F.col(column)
    style = (
        F.when(n.rlike(r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+$"), "PascalCase").when(n.rlike(r"^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+$"), "camelCase")
        .when(n.rlike(r"^[a-z0-9]+(?:_[a-z0-9]+)+$"), "snake_case").when(n.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)+$"), "kebab-case").when(n.rlike(r"^[A-Z0-9]+(?:_[A-Z0-9]+)*$"), "UPPER_CASE")
        .otherwise("other")
    )
    return names.where(n.isNotNull()).groupBy(style.alias("style")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "style").limit(1)


def tree_totals(modules: DataFrame) -> DataFrame:
    """One row: modules and component entries of a flattened tree."""
    return modules.agg(F.count_distinct("module").alias("n_modules"), F.count("component_id").alias("n_components"))


def leaf_listing(leaves: DataFrame, components: DataFrame) -> DataFrame:
    """Leaf components grouped by file with an estimate of their tokens (four characters each): (file, n, tokens)."""
    rows = components.dropDuplicates(["id"]).join(leaves.select("id").distinct(), "id", "left_semi")
    return rows.groupBy(clean_path("relative_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.length(F.coalesce("source_code", F.lit(""))) / 4)).alias("tokens")
    )


def complex_modules(modules: DataFrame, components: DataFrame) -> DataFrame:
    """Modules whose components span more than one file: (module, n_files)."""
    files = components.select(F.col("id").alias("component_id"), clean_path("relative_path").alias("f")).distinct()
    n = modules.where("component_id is not null").join(files, "component_id").groupBy("module").agg(F.count_distinct("f").alias("n_files"))
    return n.where("n_files > 1")


def source_ref_counts(pages: DataFrame) -> DataFrame:
    """How many pages refer to each source, in their text or front matter: (name, n_pages)."""
    from loomline.functions.scalar import front_matter_list, source_refs

    names = F.array_distinct(F.concat(source_refs("text"), front_matter_list("text", "sources")))
    return pages.select("doc_key", F.explode(names).alias("name")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_pages"))


def note_clusters(notes: DataFrame, least: int = 3) -> DataFrame:
    """(module, note_type, n) with at least `least` notes; `related_modules` is a list."""
    rows = notes.select("note_type", F.explode("related_modules").alias("module"), "doc_key").distinct()
    return rows.groupBy("module", "note_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def claims(text: Column | str) -> Column:
    """How many claims a text makes and how many of them lack evidence: a struct (claims, unsupported).

    A claim is a line with `(confidence: x)`; it is supported if it or one of the next two lines has a source
    reference, and never if it says `[candidate]`. Lines are judged one by one, then folded from the last to the first.
    """
    judged = F.transform(
        F.split(F.coalesce(col(text), F.lit("")), r"\r?\n"),
        lambda x: F.struct(x.rlike(r"\(confidence:\s*[^)]+\)").alias("claim"), x.contains("[candidate]").alias("never"), x.rlike(r"\[\^src:|\]\([^)]*\)|(?i)evidence:").alias("here")),
    )
    zero = F.struct(F.lit(0).alias("claims"), F.lit(0).alias("unsupported"), F.lit(False).alias("e1"), F.lit(False).alias("e2"))

    def step(acc: Column, x: Column) -> Column:
        bad = x["claim"] & (x["never"] | ~(x["here"] | acc["e1"] | acc["e2"]))
        return F.struct((acc["claims"] + x["claim"].cast("int")).alias("claims"), (acc["unsupported"] + bad.cast("int")).alias("unsupported"), x["here"].alias("e1"), acc["e1"].alias("e2"))

    return F.aggregate(F.reverse(judged), zero, step, lambda acc: F.struct(acc["claims"], acc["unsupported"]))


def unsupported_claims(pages: DataFrame, share: float = 0.3, key: str = "doc_key", text: str = "text") -> DataFrame:
    """Pages whose claims lack evidence: (doc_key, claims, unsupported, ratio) with a ratio above `share`."""
    n = pages.select(F.col(key).alias("doc_key"), claims(text).alias("c")).select("doc_key", "c.claims", "c.unsupported")
    return n.where(F.col("unsupported") > share * F.col("claims")).withColumn("ratio", F.col("unsupported") / F.col("claims"))


def isolated_by_file(isolated: DataFrame, components: DataFrame, most: int = 20) -> DataFrame:
    """Isolated components per file, the `most` fullest files: (file, n)."""
    rows = isolated.join(components.dropDuplicates(["id"]).select("id", clean_path("relative_path").alias("file")), "id")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "file").limit(most)


def entry_points(components: DataFrame, most: int = 20) -> DataFrame:
    """Components that look like entry points, best first: (id, score). Names count most, then files, then types."""
    n, f = F.lower(F.substring_index("name", ".", -1)), F.lower(F.regexp_extract(clean_path("relative_path"), r"([^/]*)$", 1))
    score = (
        F.when(n.isin("main", "run", "start", "serve", "handler", "lambda_handler", "app", "init", "bootstrap"), 3).otherwise(0)
        + F.when(f.rlike(r"^(?:main|index|app|server|cli|__main__|program|manage)\."), 2).otherwise(0)
        + F.when(kind() == "function", 1).otherwise(0)
    )
    rows = components.dropDuplicates(["id"]).select("id", score.alias("score")).where("score >= 2")
    return rows.orderBy(F.col("score").desc(), "id").limit(most)
