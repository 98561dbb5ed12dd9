"""Base-plus-delta overlays and field-level differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay_full(base: DataFrame, delta: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A delta row replaces every field of its base row; an empty cell is an explicit NULL."""
    given = delta.select(key, F.lit(True).alias("_given"), *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = base.join(given, key, "left")
    picked = {f: F.when(F.col("_given"), F.col(f"_d_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(picked).select(*base.columns)


def overlay_nonblank(base: DataFrame, delta: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A delta cell replaces the base cell unless it is blank."""
    given = delta.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = base.join(given, key, "left")
    blank = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    picked = {f: F.coalesce(blank(F.col(f"_d_{f}")), F.col(f)) for f in fields}
    return joined.withColumns(picked).select(*base.columns)


def unknown_keys(delta: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Delta keys the base does not have; an overlay is refused while there are any."""
    return delta.select(key).join(base.select(key), key, "left_anti")


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per changed field, compared null-safe, with both values as text."""
    left = before.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    right = after.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields])
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"_b_{f}").cast("string").alias("before"),
                F.col(f"_a_{f}").cast("string").alias("after"),
                (~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}"))).alias("changed"),
            )
            for f in fields
        ]
    )
    changed = left.join(right, key).select(key, F.inline(F.filter(cells, lambda c: c["changed"])))
    return changed.drop("changed")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("field").agg(F.count(F.lit(1)).alias("changes"))


def report_matches(verdicts: DataFrame, reported: DataFrame) -> DataFrame:
    """Counts of verdicts against a report (verdict, n); a verdict on one side only does not match."""
    counts = verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("found"))
    both = counts.join(reported.withColumnRenamed("n", "reported"), "verdict", "full_outer")
    return both.withColumn("ok", F.coalesce(F.col("found") == F.col("reported"), F.lit(False)))


def allowed_changes(
    base: DataFrame, delta: DataFrame, key: str, fields: Sequence[str], allowed: Sequence[str]
) -> DataFrame:
    """Verdict per delta row: its changed fields must be a non-empty subset of ``allowed``."""
    left = base.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    right = delta.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields])
    names = F.array_compact(
        F.array(*[F.when(~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}")), F.lit(f)) for f in fields])
    )
    permitted = F.array(*[F.lit(a) for a in allowed])
    judged = right.join(left, key).select(key, names.alias("changed"))
    forbidden = F.array_except("changed", permitted)
    return judged.select(
        key,
        F.array_join("changed", "|").alias("changed"),
        F.array_join(forbidden, "|").alias("forbidden"),
        F.when(F.size("changed") == 0, "no-op").when(F.size(forbidden) > 0, "forbidden").otherwise("ok").alias("verdict"),
    )
