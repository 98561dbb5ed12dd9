"""Published documents: nested summary, single-domain patch and JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def summary(spark: SparkSession, **groups: DataFrame) -> DataFrame:
    """One row with a struct per KPI group, each taken from a one-row frame."""
    return spark.range(1).select(
        *[g.select(F.struct(*g.columns)).scalar().alias(name) for name, g in groups.items()]
    )


def patch_summary(summary_row: DataFrame, group: str, kpis: DataFrame) -> DataFrame:
    """Replace one group and leave every other as published."""
    return summary_row.withColumn(group, kpis.select(F.struct(*kpis.columns)).scalar())


def json_rows(df: DataFrame, pretty: bool = False) -> DataFrame:
    """Each row as JSON text."""
    options = {"pretty": "true"} if pretty else {}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("json"))


def document(spark: SparkSession, figures: dict[str, DataFrame], lists: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One nested document as JSON text: one-row ``figures`` as objects, ``lists`` of rows in the order of their keys.

    A list has a row for each month, day, label or rank, never one for each asset or sale.
    """
    parts = [f.select(F.struct(*f.columns)).scalar().alias(name) for name, f in figures.items()]
    for name, (rows, keys) in lists.items():
        ordered = F.sort_array(F.collect_list(F.struct(F.struct(*keys).alias("_k"), F.struct(*rows.columns).alias("_r"))))
        parts.append(rows.agg(F.transform(ordered, lambda x: x["_r"])).scalar().alias(name))
    return spark.range(1).select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def section_rows(docs: DataFrame, section: str, fields: dict[str, str], item: str | None = None) -> DataFrame:
    """A section read back from ``json`` as (section, item, field, value), one row a number.

    ``fields``: the section's columns with their types; ``item`` names the key column of a list.
    """
    shape = "struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">"
    whole = f"struct<{section}:{shape}>" if item is None else f"struct<{section}:array<{shape}>>"
    found = F.from_json("json", whole)[section]
    rows = docs.select(F.inline(F.array(found) if item is None else found))
    numbers = [n for n, t in fields.items() if n != item and t in ("bigint", "double")]
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("value")) for n in numbers])
    key = F.lit("") if item is None else F.col(item).cast("string")
    return rows.select(F.lit(section).alias("section"), key.alias("item"), F.inline(cells))
