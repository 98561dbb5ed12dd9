"""Compute expensive columns once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns that later expressions may use many times.

    Neighbouring projections are merged, and a parsed document that is only read field by field
    would then be parsed again for every field, even for every array element. A one-row generator
    is a boundary the projections are not merged across.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """Use ``value`` several times within an array lambda and compute it once.

    Repeated parts of an expression are shared only outside lambdas; binding the value to the
    variable of a one-element array has the same effect inside them.
    """
    return F.get(F.transform(F.array(value), then), 0)
