"""Fixed-label histograms computed in one aggregation, empty labels kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_histogram(
    df: DataFrame, label: Column, labels: Sequence[str], name: str, measures: dict[str, Column]
) -> DataFrame:
    """One row per label in the given order; ``measures`` are summed within the label.

    All labels are aggregated side by side in one pass, so no join to a label table is needed
    and a label without rows comes out as zero. A row whose label is not in the list fails the query,
    so that the counts of the labels always add up; a NULL label means that the row is not counted.
    """
    tagged = df.select(label.alias("_label"), *[m.alias(f"_m_{k}") for k, m in measures.items()])
    cells = [
        F.coalesce(F.sum(F.when(F.col("_label") == text, F.col(f"_m_{k}"))), F.lit(0)).cast("bigint").alias(f"_{i}_{k}")
        for i, text in enumerate(labels)
        for k in measures
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("bigint").alias("ord"),
                F.lit(text).alias(name),
                *[F.col(f"_{i}_{k}").alias(k) for k in measures],
            )
            for i, text in enumerate(labels)
        ]
    )
    stray = F.max(F.when(~F.col("_label").isin(*labels), F.col("_label"))).alias("_stray")
    checked = F.when(F.col("_stray").isNull(), rows).otherwise(
        F.raise_error(F.concat(F.lit(f"{name}: unknown label "), F.col("_stray")))
    )
    return tagged.agg(*cells, stray).select(F.inline(checked))
