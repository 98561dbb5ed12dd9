"""Order-sensitive helpers that stay balanced when one key holds a large part of the rows.

A plain window puts a whole key into one task. These helpers split a key by chunks of its
order column, aggregate each chunk, and carry the chunk totals forward, so a task never holds
more than one chunk of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.session import stored

CHUNK = 1 << 18


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[c if c in keys else F.col(f"_row.{c}") for c in df.columns])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[c if c in keys else F.col(f"_row.{c}") for c in df.columns])


def dense_index(df: DataFrame, order: Sequence[str], name: str = "idx", keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Zero-based position of each row in one global order.

    The global sort range-partitions the rows; ids within a partition are dense, so only the
    per-partition counts (one row per partition) meet in one task. ``keep`` holds the sorted rows, which are read twice.
    """
    ranked = keep(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    place = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # One row per sort partition, hence at most spark.sql.shuffle.partitions rows.
    return (
        ranked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + place)
        .drop("_mid", "_part", "_base")
    )


def exclusive_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    backwards: bool = False,
) -> DataFrame:
    """Add aggregates over all earlier rows of the same key (later rows if ``backwards``).

    ``sums`` start at zero, ``maxima`` at NULL (``minima`` when running backwards). ``chunk`` must
    rise with the first order column. Key columns must not be NULL.
    """
    sums, maxima = sums or {}, maxima or {}
    extreme = F.min if backwards else F.max
    pick = F.least if backwards else F.greatest
    arrange = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    work = df.withColumn("_chunk", chunk)
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*[arrange(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*keys).orderBy(arrange("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = work.select(
        "*",
        *[F.sum(e).over(inside).alias(f"_l_{n}") for n, e in sums.items()],
        *[extreme(e).over(inside).alias(f"_l_{n}") for n, e in maxima.items()],
    )
    totals = work.groupBy(*keys, "_chunk").agg(
        *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()],
        *[extreme(e).alias(f"_t_{n}") for n, e in maxima.items()],
    )
    carried = totals.select(
        *keys,
        "_chunk",
        *[F.sum(f"_t_{n}").over(across).alias(f"_c_{n}") for n in sums],
        *[extreme(f"_t_{n}").over(across).alias(f"_c_{n}") for n in maxima],
    )
    zero = F.lit(0)
    return local.join(carried, [*keys, "_chunk"]).select(
        *df.columns,
        *[(F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_c_{n}", zero)).alias(n) for n in sums],
        *[pick(f"_l_{n}", f"_c_{n}").alias(n) for n in maxima],
    )


def running_total(df: DataFrame, order: str, measures: dict[str, str]) -> DataFrame:
    """Running totals over a calendar spine: one row per period, so one small window."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[F.sum(m).over(upto).alias(total) for m, total in measures.items()])
