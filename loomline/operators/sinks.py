"""Writers: whole tables as files, graphs and reports as JSON and text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """A table as parquet, partitioned by columns."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bucketed(df: DataFrame, table: str, by: tuple[str, ...], buckets: int, mode: str = "overwrite") -> None:
    """A catalogue table bucketed and sorted by its join key, so that later joins on it need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(table)


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> dict:
    """A result as JSON lines, and its compact summary: path, rows and columns."""
    df.write.mode(mode).json(path)
    return {"path": path, "rows": df.sparkSession.read.json(path).count() if df.columns else 0, "columns": df.columns}


def graph_json(components: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text for each component with what it depends on, sorted: (id, node)."""
    deps = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    rows = components.dropDuplicates(["id"]).join(deps, "id", "left") if "depends_on" not in components.columns else components.drop("depends_on").dropDuplicates(["id"]).join(deps, "id", "left")
    return rows.select("id", F.to_json(F.struct("id", "name", "component_type", "relative_path", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))).alias("node"))


def chart_elements(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements of a network chart: (kind, element) with a JSON object for each node and each edge between known nodes."""
    ids = components.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    node = F.to_json(F.struct(F.struct(F.col("id"), F.col("name").alias("label"), F.col("component_type").alias("type")).alias("data")))
    edge = F.to_json(F.struct(F.struct(F.concat("src", F.lit("->"), "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target")).alias("data")))
    return components.dropDuplicates(["id"]).select(F.lit("node").alias("kind"), node.alias("element")).unionByName(e.select(F.lit("edge").alias("kind"), edge.alias("element")))


def index_page(pages: DataFrame) -> DataFrame:
    """The lines of the index page in order: overview first, pages by title, notes newest first: (section, line)."""
    name = F.coalesce("title", "doc_key")
    line = F.concat(F.lit("- ["), name, F.lit("]("), F.col("doc_key"), F.lit(")"))
    first = F.when(F.lower("doc_key").rlike(r"(^|/)overview\.md$"), 0).otherwise(1)
    newest = F.when(F.col("source") == "note", -F.coalesce(F.unix_timestamp(F.col("updated_at").cast("timestamp")), F.lit(0))).otherwise(F.lit(0))
    return pages.orderBy("source", first, newest, name, "doc_key").select(F.col("source").alias("section"), line.alias("line"))


def operation_log(entries: DataFrame) -> DataFrame:
    """Log entries with their day, newest day first and in order within it: (day, at, operation, detail)."""
    return entries.select(F.to_date("at").alias("day"), "at", "operation", "detail").orderBy(F.col("day").desc(), "at")


def write_bounded_json(df: DataFrame, path: str, most: int = 10_000) -> int:
    """A small report as one JSON list in a file; refuses more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write_result writes results of any size")
    Path(path).write_text(json.dumps([r.asDict(recursive=True) for r in rows], default=str, ensure_ascii=False, indent=1))
    return len(rows)
