"""Rows in one global order whose positions follow late rows: sealed ranges with counts.

The rows are kept in ranges of the order, each with its lowest key and its number of rows, and a row with its place inside its
range. A position is the number of rows in all ranges before, plus that place; it is never stored. So a row that comes late, far
before the end, moves the positions of all that follow without touching them: only the ranges that get rows are written anew, and
a range is split where it holds twice its size. What is computed from the rows of one range by place, such as the places of each
wallet, is written with the range and shifted the same way.

A range that was written anew is deleted with the commit after the next one, so a reader that has just looked up the last commit is
not cut off. Keys together tell rows apart and are not NULL; a row whose keys are stored already is ignored, and of fresh copies
the first by the other columns is taken. An empty batch commits a version without rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.functions.ordered import exclusive_prefix, keep_first
from ledgerweave.session import settled
from ledgerweave.sources.tables import ByChange, commit_version, is_committed, latest_version, read_latest

RANGE = 1 << 20
ROWS, RANGES = "rows", "ranges"


def _shape(rows: DataFrame, root: str, name: str) -> None:
    """A file without rows, which gives a reader the columns when there are no ranges."""
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}_shape")


def _folders(spark: SparkSession, root: str, name: str, found: list[tuple[int, int]]) -> DataFrame:
    """The rows of these ranges, given by version and number; no other folder is listed."""
    paths = [f"{root}/{name}/made={made}/rid={rid}" for made, rid in found]
    return spark.read.option("basePath", f"{root}/{name}").parquet(*paths)


def _placed(fresh: DataFrame, ranges: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Add the number of the range of each row: that of the last lowest key not above its own, or the first range.

    Rows and lowest keys are walked together in chunks of the order, so nothing is broadcast and no task holds all of either.
    """
    lows = ranges.select("low.*", "rid")
    walk = fresh.select(*keys, F.lit(None).cast("bigint").alias("rid"), F.lit(1).alias("_turn"))
    walk = walk.unionByName(lows.withColumn("_turn", F.lit(0)))
    low = F.when(F.col("rid").isNotNull(), F.struct(*keys, "rid"))
    found = exclusive_prefix(walk, [], [*keys, "_turn"], chunk, maxima={"_low": low}).filter("_turn = 1")
    first = ranges.agg(F.min_by("rid", "low")).scalar()
    return fresh.join(found.select(*keys, F.coalesce("_low.rid", first).alias("rid")), list(keys))


def _pieces(rows: DataFrame, keys: Sequence[str], chunk: Column, size: int, first: int) -> DataFrame:
    """Rows with the numbers of their new ranges, from ``first`` on, and their places there."""
    counts = rows.groupBy("rid").agg(F.count(F.lit(1)).alias("_n"))
    # A range of twice the size or more becomes ranges of at least the size each.
    counts = counts.withColumn("_parts", F.greatest(F.lit(1), F.expr(f"_n div {size}")))
    before = Window.orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range that the batch touches.
    counts = counts.withColumn("_base", F.coalesce(F.sum("_parts").over(before), F.lit(0)))
    walked = exclusive_prefix(rows, ["rid"], list(keys), chunk, sums={"_pos": F.lit(1)}).join(counts, "rid")
    part = F.expr("(_pos * _parts) div _n")
    # The first row of part p is the least pos with pos * parts >= p * n.
    start = F.expr("(_part * _n + _parts - 1) div _parts")
    walked = walked.withColumn("_part", part).withColumn("place", F.col("_pos") - start)
    number = F.col("_base") + F.col("_part") + F.lit(first)
    return walked.withColumn("rid", number.cast("bigint")).drop("_n", "_parts", "_base", "_pos", "_part")


def append_ordered(
    spark: SparkSession,
    root: str,
    fresh: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    size: int = RANGE,
    derived: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    stream: str | None = None,
    batch: int | None = None,
) -> int:
    """Add rows to the ordered table at ``root``; returns the version.

    ``chunk`` rises with the first key and bounds what one task walks. ``derived`` maps rows with ``rid`` and ``place`` to rows with
    ``rid``, for each of the tables written beside them.
    """
    last = latest_version(spark, root)
    if stream is not None and is_committed(spark, root, stream, batch):
        return last
    version = 0 if last is None else last + 1
    fresh = keep_first(fresh, list(keys), [c for c in fresh.columns if c not in keys])
    known = read_latest(spark, root, RANGES) if last is not None else None
    alive = None if known is None else settled(known.filter("n > 0"))
    top = 0 if known is None else known.agg(F.coalesce(F.max("rid") + 1, F.lit(0))).first()[0]
    gone: list[tuple[int, int]] = []
    if alive is None or alive.isEmpty():
        merged = fresh.withColumn("rid", F.lit(0).cast("bigint"))
    else:
        placed = settled(_placed(fresh, alive, keys, chunk))
        merged, gone = _merged(spark, root, placed, alive, keys)
    pieces = _pieces(merged, keys, chunk, size, top)
    pieces = pieces.repartition("rid").sortWithinPartitions("rid", *keys)
    pieces.write.mode("overwrite").partitionBy("rid").parquet(f"{root}/{ROWS}/made={version}")
    written = spark.read.schema(pieces.schema).parquet(f"{root}/{ROWS}/made={version}")
    for name, rule in (derived or {}).items():
        beside = rule(written)
        beside.repartition("rid").write.mode("overwrite").partitionBy("rid").parquet(f"{root}/{name}/made={version}")
        if last is None:
            _shape(beside, root, name)
    if last is None:
        _shape(written, root, ROWS)
    made = written.groupBy("rid").agg(F.min(F.struct(*keys)).alias("low"), F.count(F.lit(1)).alias("n"))
    made = made.withColumn("made", F.lit(version))
    if gone:
        dead = alive.join(spark.createDataFrame(gone, "made int, rid bigint"), ["made", "rid"])
        made = made.unionByName(dead.withColumn("n", F.lit(0).cast("bigint")).select("rid", "low", "n", "made"))
    commit_version(spark, root, {RANGES: ByChange(made, "rid", "n > 0")}, stream, batch)
    if known is not None:
        _delete(spark, root, [ROWS, *(derived or {})], known.filter("n = 0").select("made", "rid").collect())
    return version


def _merged(spark, root, placed: DataFrame, alive: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Stored and new rows of the ranges that get any, and these ranges; the driver sees their names, as of files to read."""
    touched = lambda rows: sorted((r["made"], r["rid"]) for r in alive.join(rows.select("rid").distinct(), "rid", "left_semi").collect())
    names = touched(placed)
    if not names:
        return placed, []
    stored = _folders(spark, root, ROWS, names).withColumn("rid", F.col("rid").cast("bigint"))
    new = settled(placed.join(stored.select(*keys), list(keys), "left_anti"))
    names = touched(new)
    if not names:
        return new, []
    stored = _folders(spark, root, ROWS, names).withColumn("rid", F.col("rid").cast("bigint"))
    return stored.select(*new.columns).unionByName(new), names


def _delete(spark: SparkSession, root: str, names: Sequence[str], dead: list) -> None:
    for name in names:
        for made, rid in dead:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/made={made}/rid={rid}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def range_bases(spark: SparkSession, root: str) -> DataFrame:
    """Ranges with ``base``, the position of their first row; one row a range, ordered in one task."""
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    alive = read_latest(spark, root, RANGES).filter("n > 0")
    return alive.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def read_ranges(spark: SparkSession, root: str, name: str = ROWS, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the table, or of one beside it, with the ``base`` of their range; ranges outside positions low..high are not read."""
    bases = range_bases(spark, root)
    if low is not None or high is not None:
        inside = F.lit(True) if high is None else F.col("base") <= high
        inside = inside if low is None else inside & (F.col("base") + F.col("n") > low)
        bases = bases.filter(inside)
    names = [(r["made"], r["rid"]) for r in bases.select("made", "rid").collect()]
    if not names:
        return spark.read.parquet(f"{root}/{name}_shape").limit(0).withColumn("base", F.lit(0).cast("bigint"))
    rows = _folders(spark, root, name, names).withColumn("rid", F.col("rid").cast("bigint")).drop("made")
    return rows.join(bases.select("rid", "base"), "rid")


def read_positions(spark: SparkSession, root: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows with their position ``idx``, from ``low`` to ``high``."""
    rows = read_ranges(spark, root, ROWS, low, high).withColumn("idx", F.col("base") + F.col("place")).drop("rid", "base", "place")
    rows = rows if low is None else rows.filter(F.col("idx") >= low)
    return rows if high is None else rows.filter(F.col("idx") <= high)
