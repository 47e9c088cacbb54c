"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.ids import clean_id, is_blank


def valid_runs(runs: DataFrame) -> DataFrame:
    """The run that holds for each snapshot of a repository, numbered without gaps.

    Only complete runs count; of several for one snapshot the one delivered last holds (ties: greatest
    run_id). Gives (run_id, repo_name, snapshot_no, idx, last_idx, next_no): idx runs from 1, next_no is the
    following snapshot's number. Repeated run rows count once.
    """
    held = (
        runs.where((F.lower(F.trim("run_state")) == "complete") & F.col("snapshot_no").isNotNull())
        .groupBy("repo_name", "snapshot_no")
        .agg(F.max_by("run_id", F.struct("delivered_at", "run_id")).alias("run_id"))
    )
    by = Window.partitionBy("repo_name").orderBy("snapshot_no")
    return held.select(
        "run_id",
        "repo_name",
        "snapshot_no",
        F.row_number().over(by).alias("idx"),
        F.count(F.lit(1)).over(Window.partitionBy("repo_name")).alias("last_idx"),
        F.lead("snapshot_no").over(by).alias("next_no"),
    )


def comparable_hash(h: Column | str) -> Column:
    """A hash for comparison: in lower case without white space; null where none is given."""
    c = F.lower(F.regexp_replace(F.col(h) if isinstance(h, str) else h, r"\s", ""))
    return F.when(c != "", c)


def hashes_differ(a: Column, b: Column, short: int = 16) -> Column:
    """Whether two comparable hashes differ; where one gives its first `short` digits only, these are compared."""
    cut = (F.length(a) <= short) | (F.length(b) <= short)
    return F.when(cut, F.substring(a, 1, short) != F.substring(b, 1, short)).otherwise(a != b)


def snapshot_changes(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Differences between consecutive valid snapshots: (repo_name, snapshot_no, id, change_kind).

    Each key is windowed by its snapshot index: a gap before an index is an addition, a gap after it a
    removal, and a hash that differs from the lagged one of the index before a change. Rows of one key in
    one run are first reduced to that of the greatest `ord` (combined before the shuffle, so repeats of a
    key never meet in one task). Hashes count only where both snapshots give one. Rows with a null or
    blank id, or of runs that do not hold, are left out; the first snapshot gives no rows; a valid run
    without rows removes everything. Extra columns are ignored.
    """
    held = valid_runs(runs.select("run_id", "repo_name", "snapshot_no", "delivered_at", "run_state"))
    rows = (
        snapshots.where(~is_blank("id"))
        .select("run_id", clean_id("id").alias("id"), "ord", comparable_hash("content_hash").alias("h"))
        .join(held, "run_id")
        .groupBy("repo_name", "id", "idx", "snapshot_no", "last_idx", "next_no")
        .agg(F.max(F.struct("ord", "h"))["h"].alias("h"))
    )
    key = Window.partitionBy("repo_name", "id").orderBy("idx")
    seen = rows.select(
        "*",
        F.lag("idx").over(key).alias("before"),
        F.lag("h").over(key).alias("h_before"),
        F.lead("idx").over(key).alias("after"),
    )
    adjacent = F.col("before") == F.col("idx") - 1
    here = F.when((F.col("idx") > 1) & ~F.coalesce(adjacent, F.lit(False)), "added").when(
        adjacent & hashes_differ(F.col("h"), F.col("h_before")), "changed"
    )
    gone = F.when(
        (F.col("idx") < F.col("last_idx")) & F.coalesce(F.col("after") > F.col("idx") + 1, F.lit(True)), "removed"
    )
    events = F.array(
        F.struct(F.col("snapshot_no").alias("no"), here.alias("kind")),
        F.struct(F.col("next_no").alias("no"), gone.alias("kind")),
    )
    return (
        seen.select("repo_name", "id", F.explode(events).alias("e"))
        .where(F.col("e.kind").isNotNull())
        .select("repo_name", F.col("e.no").alias("snapshot_no"), "id", F.col("e.kind").alias("change_kind"))
    )
