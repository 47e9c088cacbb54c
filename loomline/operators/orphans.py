"""References to records that do not exist (any more, or yet)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.ids import id_name, id_path, is_blank
from loomline.operators.skew import salted_join

MATCHES = ("simple", "full", "partial")


def orphan_references(
    refs: DataFrame,
    records: DataFrame,
    keys: Mapping[str, str] | Sequence[str],
    match: str = "simple",
    at: str | None = None,
    valid_from: str | None = None,
    valid_to: str | None = None,
    kind: str = "orphan_kind",
) -> DataFrame:
    """The rows of `refs` whose key leads to no record of `records`, with a column `kind`.

    `keys` maps the columns of the reference to those of the record. References are grouped by which of
    their key columns are null; each such mask is joined on its non-null columns only:

    * no column null: the record must exist.
    * all columns null: never an orphan.
    * some null: `simple` accepts them, `full` reports them (`missing`), `partial` asks for a record that
      agrees in the non-null columns.

    Kinds are `missing`, and, where `at`, `valid_from` and `valid_to` are given, `deleted` (the record ended
    at or before `at`) and `late` (it began after `at`). A null `at` gives only `missing`; a null
    `valid_from` or `valid_to` is an open end. Of several records with one key the widest life counts.
    Records with a null key column can be met through their other columns only. Repeated references stay
    repeated, other columns of either table are carried or ignored whatever their names; empty tables give
    no rows (no references) or every non-null reference (no records).
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    cols = list(pairs)
    timed = at is not None
    own = [f"__k{i}" for i in range(len(cols))]
    work = refs.select("*", *(F.col(f"`{c}`").alias(o) for c, o in zip(cols, own, strict=True)))
    life = [
        (F.col(f"`{valid_from}`") if timed and valid_from else F.lit(None).cast("timestamp")).alias("__from"),
        (F.col(f"`{valid_to}`") if timed and valid_to else F.lit(None).cast("timestamp")).alias("__to"),
    ]
    known = records.select(*(F.col(f"`{pairs[c]}`").alias(o) for c, o in zip(cols, own, strict=True)), *life)
    masks = []
    for mask in product([False, True], repeat=len(cols)):
        if all(mask) or (any(mask) and match == "simple"):
            continue
        part = work.where(_masked(own, mask))
        if any(mask) and match == "full":
            masks.append(part.withColumn(kind, F.lit("missing")).drop(*own))
            continue
        by = [o for o, null in zip(own, mask, strict=True) if not null]
        there = (
            known.where(_masked(by, [False] * len(by)))
            .groupBy(*by)
            .agg(
                # an open end on any record with the key is an open end of the key
                F.when(F.count("__from") == F.count(F.lit(1)), F.min("__from")).alias("__from"),
                F.when(F.count("__to") == F.count(F.lit(1)), F.max("__to")).alias("__to"),
                F.lit(True).alias("__there"),
            )
        )
        spread = [c for c in part.columns if c not in own and _hashable(part, c)]
        joined = salted_join(part, there, by, "left", spread=[f"`{c}`" for c in spread] or None)
        when = F.col(f"`{at}`") if timed else F.lit(None).cast("timestamp")
        found = (
            F.when(F.col("__there").isNull(), "missing")
            .when(F.col("__to") <= when, "deleted")
            .when(F.col("__from") > when, "late")
        )
        masks.append(
            joined.withColumn(kind, found).where(F.col(kind).isNotNull()).select(*(f"`{c}`" for c in refs.columns), kind)
        )
    out = masks[0]
    for other in masks[1:]:
        out = out.unionByName(other)
    return out


def _masked(cols: Sequence[str], mask: Sequence[bool]) -> Column:
    test = F.lit(True)
    for c, null in zip(cols, mask, strict=True):
        test = test & (F.col(c).isNull() if null else F.col(c).isNotNull())
    return test


def _hashable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString()


def component_references(dependencies: DataFrame, components: DataFrame, calls: DataFrame) -> DataFrame:
    """All references of the knowledge base: (ref_table, source_id, target_id, at), null and blank targets left out."""
    parts = [
        dependencies.select(F.lit("dependencies").alias("ref_table"), "source_id", "target_id", F.col("recorded_at").alias("at")),
        components.select(
            F.lit("components").alias("ref_table"),
            F.col("id").alias("source_id"),
            F.explode("depends_on").alias("target_id"),
            F.col("analyzed_at").alias("at"),
        ),
        calls.where(F.col("is_resolved")).select(
            F.lit("calls").alias("ref_table"),
            F.col("caller").alias("source_id"),
            F.col("callee").alias("target_id"),
            F.col("recorded_at").alias("at"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(~is_blank("target_id"))


def orphan_component_references(dependencies: DataFrame, components: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct orphan references (ref_table, ref_month, source_id, target_id, orphan_kind).

    A component id is a composite key of path and name, compared in clean notation. A target without a path
    has a null in the key; MATCH FULL is declared, so it is missing. A null time gives a null month.
    """
    refs = component_references(dependencies, components, calls).select(
        "*", id_path("target_id").alias("path"), id_name("target_id").alias("name")
    )
    records = components.where(~is_blank("id")).select(
        id_path("id").alias("path"), id_name("id").alias("name"), "first_seen_at", "deleted_at"
    )
    found = orphan_references(refs, records, ["path", "name"], "full", "at", "first_seen_at", "deleted_at")
    return found.select(
        "ref_table", F.date_format("at", "yyyy-MM").alias("ref_month"), "source_id", "target_id", "orphan_kind"
    ).distinct()


def orphan_rates(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month and kind."""
    return orphans.groupBy("ref_table", "ref_month", "orphan_kind").agg(F.count(F.lit(1)).alias("n_orphans"))
