"""Equi-joins whose probe side has hot keys.

One key may hold a third of all rows. The `HOT_KEYS` most frequent keys are found by an exact count (combined on the
map side, so a hot key costs one row per task); a key beyond them holds less than one in `HOT_KEYS` of all rows. Each
gets as many salts as its count asks for: the probe side spreads over them, the build side is repeated for
these keys only. The list of hot keys has at most `HOT_KEYS` rows whatever the input, so broadcasting it is safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 2000
#: Rows of a hot key for which one salt is enough, and the most salts of a key.
ROWS, MOST_SALTS = 50_000, 10_000
SALT = "__salt"


def hot_keys(df: DataFrame, keys: Sequence[str], n: int = HOT_KEYS, rows: int = ROWS) -> DataFrame:
    """The `n` most frequent keys of more than `rows` rows, with one salt per `rows`: (keys..., __salts)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__hot_n")).where(F.col("__hot_n") > rows)
    top = counts.orderBy(F.col("__hot_n").desc(), *keys).limit(n)
    return top.select(*keys, F.least(F.ceil(F.col("__hot_n") / rows), F.lit(MOST_SALTS)).cast("int").alias("__salts"))


def _picked(salts: Column, by: Sequence[Column | str]) -> Column:
    """The salt of a probe row by the hash of some of its columns; 0 for keys that are not hot."""
    return F.when(salts.isNotNull(), F.pmod(F.xxhash64(*by), salts).cast("int")).otherwise(F.lit(0))


def _every(salts: Column) -> Column:
    return F.explode(F.when(salts.isNotNull(), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0))))


def salted_join(
    probe: DataFrame,
    build: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread: Sequence[Column | str] | None = None,
    rows: int = ROWS,
) -> DataFrame:
    """`probe` joined with `build` on `keys` (null keys match nothing), hot probe keys spread over salts.

    `how` is left, inner, left_semi or left_anti: kinds that keep each probe row in one place, so the
    result equals the unsalted join. `spread` are the probe columns whose hash picks the salt.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"salting would repeat rows of a {how} join")
    keys = list(keys)
    hot = F.broadcast(hot_keys(probe.select(*keys), keys, rows=rows))
    by = [F.col(c) if isinstance(c, str) else c for c in (spread or [c for c in probe.columns if c not in keys] or keys)]
    left = probe.join(hot, keys, "left").withColumn(SALT, _picked(F.col("__salts"), by)).drop("__salts")
    right = build.join(hot, keys, "left").withColumn(SALT, _every(F.col("__salts"))).drop("__salts")
    return left.join(right, [*keys, SALT], how).drop(SALT)


class Probe:
    """The probe side of a join that is repeated with changing build sides, as iterative operators do.

    Its hot keys are looked up once; they are at most `HOT_KEYS` values, so the driver may hold them.
    """

    def __init__(self, df: DataFrame, key: str, rows: int = ROWS):
        self.key = key
        held = hot_keys(df.select(key), [key], rows=rows).collect()
        self.hot = df.sparkSession.createDataFrame(held, df.select(key, F.lit(0).alias("__salts")).schema) if held else None
        if self.hot is None:
            self.df = df
            return
        others = [F.col(c) for c in df.columns if c != key] or [F.col(key)]
        self.df = df.join(F.broadcast(self.hot), key, "left").withColumn(SALT, _picked(F.col("__salts"), others)).drop("__salts")

    def join(self, build: DataFrame) -> DataFrame:
        """The inner join with `build` on the key."""
        if self.hot is None:
            return self.df.join(build, self.key)
        wide = build.join(F.broadcast(self.hot), self.key, "left").withColumn(SALT, _every(F.col("__salts"))).drop("__salts")
        return self.df.join(wide, [self.key, SALT]).drop(SALT)


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many partitions as the session has cores, if its scan gives fewer; else `df` itself.

    For work that costs much more than moving the rows, on tables in a few files. Large tables are not moved, nor are
    results of a shuffle, whose partitions are not known before they run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
