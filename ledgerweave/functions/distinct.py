"""Exact distinct counts without multiplying rows.

Several distinct counts in one aggregate copy each row once for each of them. Here one of them goes along with the other
figures and each further one is an aggregate of its own, a scalar of the query around it. Codes that are dense from 0, such as
those of ``dict_encode``, become bits: a bucket of 32,768 codes is 4 KB whatever the number of rows, and what is shuffled is one
bitmap for each bucket and task, never a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_count(rows: DataFrame, column: str, dense: bool = False) -> Column:
    """Number of distinct non-NULL values as a scalar; ``dense`` says that they are codes without large gaps."""
    values = rows.select(F.col(column).alias("_v")).filter("_v IS NOT NULL")
    if not dense:
        return values.distinct().agg(F.count(F.lit(1))).scalar()
    code = F.col("_v").cast("bigint")
    bits = values.groupBy(F.bitmap_bucket_number(code).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(code)).alias("_bits"))
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0))).scalar()


def agg_distinct(rows: DataFrame, figures: dict[str, Column], column: Column, name: str, dense: bool = False) -> DataFrame:
    """One row: ``figures`` (aggregates that add up: counts and sums) and the distinct non-NULL values of ``column``."""
    if not dense:
        return rows.agg(*[e.alias(n) for n, e in figures.items()], F.count_distinct(column).alias(name))
    code = column.cast("bigint")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(code)).alias("_bits")
    parts = rows.groupBy(F.bitmap_bucket_number(code).alias("_bucket")).agg(*[e.alias(n) for n, e in figures.items()], bits)
    known = F.when(F.col("_bucket").isNotNull(), F.bitmap_count("_bits"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return parts.agg(*[total(n).alias(n) for n in figures], total(known).alias(name))
