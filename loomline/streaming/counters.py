"""The streaming forms of counters, sessions and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.operators.changes import latest, upsert


def hit_counters(hits: DataFrame, late: str = "7 days") -> DataFrame:
    """Retrieval counters of a stream of hits (file_path, query, at), per file and day, in update mode.

    Days that lie further back than the watermark are dropped from the state, which bounds it.
    """
    day = F.window("at", "1 day")
    return hits.withWatermark("at", late).groupBy("file_path", day.alias("w")).agg(
        F.count(F.lit(1)).alias("hit_count"), F.max_by("query", "at").alias("last_query"), F.min("at").alias("first_hit"), F.max("at").alias("last_hit")
    ).select("file_path", F.col("w.start").cast("date").alias("day"), "hit_count", "last_query", "first_hit", "last_hit")


def session_stream(events: DataFrame, gap: str = "2 hours", late: str = "1 day", user: str = "user_id", at: str = "ts") -> DataFrame:
    """Sessions of a stream of events; a session comes out once the watermark has passed its end (append mode)."""
    w = F.session_window(F.col(at), gap)
    return events.withWatermark(at, late).groupBy(user, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max(at).alias("ended")).select(
        user, F.col("w.start").alias("started"), "ended", "n_events"
    )


def first_arrivals(sources: DataFrame, late: str = "1 day", key: str = "content_hash", at: str = "at") -> DataFrame:
    """Sources of a stream without repeats of a content within the watermark."""
    return sources.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def upsert_stream(rows: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Keeps a parquet table of the latest row of each key: every micro-batch gives a new version in a folder of its own.

    Versions are `table/v=<batch>`; a batch that is run again after a failure writes the same version again.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, keys, order)
        before = f"{table}/v={number - 1}"
        try:
            old = spark.read.parquet(before) if number else None
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        out = fresh if old is None else latest(upsert(old, fresh, keys), keys, order)
        out.write.mode("overwrite").parquet(f"{table}/v={number}")

    return foreach_batch(rows, apply, checkpoint, trigger)


def foreach_batch(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream that hands its micro-batches to a function; by default it ends when all input is read."""
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
