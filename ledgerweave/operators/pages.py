"""Pages of a long list by cursor: rows clustered by set and order, so that a page reads the files of its set and no others.

``write_pages`` stores the rows in one global order of set and keys, cut into files by range, so a set that holds a large part
of all rows is many files and many small sets share one. Beside them lie the bounds of each file and of each page. A page is
read by its number or from the cursor that the page before returned: the keys of its last row. A cursor stays right while
rows are added, numbers do not.

Keys rise; a descending order is given by its negated value. Set and keys together tell rows apart and are not NULL.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions.ordered import exclusive_prefix


def page_index(rows: DataFrame, set_col: str, keys: Sequence[str], size: int, chunk: Column) -> DataFrame:
    """``set, page`` (from 1), the keys of its first row, and ``n`` rows; ``chunk`` rises with the first key.

    Places are counted in chunks of a set, so no task holds a whole one.
    """
    placed = exclusive_prefix(rows.select(set_col, *keys), [set_col], list(keys), chunk, sums={"_pos": F.lit(1)})
    page = (F.floor(F.col("_pos") / size) + 1).cast("bigint").alias("page")
    pages = placed.groupBy(set_col, page).agg(F.min(F.struct(*keys)).alias("_first"), F.count(F.lit(1)).alias("n"))
    return pages.select(set_col, "page", *[F.col(f"_first.{k}") for k in keys], "n")


def write_pages(rows: DataFrame, path: str, set_col: str, keys: Sequence[str], size: int, chunk: Column, files: int | None = None) -> None:
    """Store ``rows`` with the bounds of their files and of their pages of ``size``; Spark chooses how many ``files``, if None."""
    order = [set_col, *keys]
    ranged = rows.repartitionByRange(*order) if files is None else rows.repartitionByRange(files, *order)
    ranged.sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows")
    place = F.struct(*order)
    bounds = stored.groupBy(F.input_file_name().alias("file")).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n"))
    bounds.coalesce(1).write.parquet(f"{path}/files")  # one row a file
    page_index(stored, set_col, keys, size, chunk).repartitionByRange(set_col, "page").sortWithinPartitions(set_col, "page").write.parquet(f"{path}/pages")


def _after(order: Sequence[str], values: Sequence, inclusive: bool) -> Column:
    """Is the row behind these values? Written out by column, so that file statistics can be used."""
    test = F.lit(inclusive)
    for name, value in reversed(list(zip(order, values, strict=True))):
        test = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & test)
    return test & (F.col(order[0]) >= F.lit(values[0]))


def read_page(
    spark: SparkSession,
    path: str,
    set_col: str,
    keys: Sequence[str],
    set_id,
    size: int,
    cursor: str | None = None,
    page: int | None = None,
    where: Column | None = None,
) -> tuple[DataFrame, str | None]:
    """The next ``size`` rows of a set after ``cursor`` (from page ``page``, or from the start), and the next cursor, if any.

    ``where`` keeps some of the rows, such as those of one kind. Files are read from the cursor on until the page is full; as a
    rule that is one file, or two.
    """
    start, inclusive = (json.loads(cursor), False) if cursor else (None, True)
    if start is None and page is not None:
        first = spark.read.parquet(f"{path}/pages").filter((F.col(set_col) == F.lit(set_id)) & (F.col("page") == page)).select(*keys).first()
        if first is None:
            return spark.read.parquet(f"{path}/rows").limit(0), None
        start = list(first)
    bounds = spark.read.parquet(f"{path}/files").filter((F.col(f"low.{set_col}") <= F.lit(set_id)) & (F.col(f"high.{set_col}") >= F.lit(set_id)))
    if start is not None:
        bounds = bounds.filter(F.col("high") >= F.struct(F.lit(set_id).alias(set_col), *[F.lit(v).alias(k) for k, v in zip(keys, start, strict=True)]))
    files = [r["file"] for r in bounds.orderBy("low").select("file").collect()]
    take = 1
    while True:
        if not files:
            return spark.read.parquet(f"{path}/rows").limit(0), None
        rows = spark.read.parquet(*files[:take]).filter(F.col(set_col) == F.lit(set_id))
        if start is not None:
            rows = rows.filter(_after([set_col, *keys], [set_id, *start], inclusive))
        if where is not None:
            rows = rows.filter(where)
        # One row more than the page tells whether there is another.
        found = rows.orderBy(*keys).limit(size + 1)
        ends = found.select(*keys).collect()
        if len(ends) > size or take >= len(files):
            more = len(ends) > size
            return found.limit(size), json.dumps(list(ends[size - 1])) if more else None
        take *= 2
