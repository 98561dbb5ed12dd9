"""Versioned tables in the shared folder: all outputs of a batch become visible together.

Every batch writes its frames under its own version and then one commit row. Readers follow the last commit only, so a batch
that stopped half-way is invisible, and running it again overwrites what it left behind. Versions count up by one, so all up to
the last are committed. One writer at a time is assumed.

What a batch reads and writes must follow the batch, not the history:

* The commit row says all that a reader needs: the last micro-batch of each stream, and for tables kept by change where
  their rows lie. So older commit rows expire.
* A table kept by change (``ByChange``) holds a whole table in a base version and only changed rows after it. Readers take the
  last row of each key. When ``FOLD_EVERY`` versions have changed it, the next one folds it into a new base; what lies before
  the base before expires, so a reader that has just looked up the last commit is not cut off.
* A table that versions add to can be read from a version on, or where its order column overlaps a range. The ranges of all
  versions are a small table kept by change.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COMMITS = "commits"
SPANS = "spans"
FOLD_EVERY = 8
COMMIT_ROW = (
    "stream string, batch bigint, committed_at timestamp, streams map<string,bigint>, "
    "folds map<string,struct<base: int, key: string, changes: array<int>>>, version int"
)


class ByChange(NamedTuple):
    """Rows of a table kept by change, by their unique ``key``; the table's first version has to be all of it.

    A new base leaves out what fails the condition ``live``, unless its own version brought it.
    """

    rows: DataFrame
    key: str
    live: str | None = None


def sorted_write(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Write a table in key order: ranges across files, sorted inside each; without keys, the rows as they lie."""
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def commit_version(
    spark: SparkSession,
    root: str,
    frames: dict[str, tuple[DataFrame, Sequence[str]] | ByChange],
    stream: str | None = None,
    batch: int | None = None,
    span: tuple[int, int] | None = None,
) -> int:
    """Write each frame, given with its sort keys or by change, under the next version, then commit them in one step.

    ``span``: least and greatest order value of the rows this version adds, for ``read_overlapping``.
    """
    last = latest_commit(spark, root)
    version = 0 if last is None else last["version"] + 1
    folds = {} if last is None else {name: fold.asDict() for name, fold in (last["folds"] or {}).items()}
    streams = {} if last is None else dict(last["streams"] or {})
    if stream is not None:
        streams[stream] = batch
    if span is not None:
        own = spark.createDataFrame([(version, *span)], "at int, low bigint, high bigint")
        frames = {**frames, SPANS: ByChange(own, "at")}
    stale: dict[str, int] = {}
    for name, frame in frames.items():
        path = f"{root}/{name}/version={version}"
        if not isinstance(frame, ByChange):
            sorted_write(frame[0], path, frame[1])
            continue
        fold = folds.get(name)
        if fold is not None and len(fold["changes"]) < FOLD_EVERY:
            sorted_write(frame.rows, path, [frame.key])
            fold["changes"] = [*fold["changes"], version]
            continue
        rows = frame.rows
        if fold is not None:
            kept = _folded(spark, root, name, fold).join(rows.select(frame.key), frame.key, "left_anti")
            kept = kept if frame.live is None else kept.filter(frame.live)
            rows = kept.unionByName(rows)
            stale[name] = fold["base"]
        sorted_write(rows, path, [frame.key])
        folds[name] = {"base": version, "key": frame.key, "changes": []}
    row = spark.createDataFrame(
        [(stream, batch, None, streams, {n: (f["base"], f["key"], f["changes"]) for n, f in folds.items()})],
        COMMIT_ROW.removesuffix(", version int"),
    )
    row = row.withColumn("committed_at", F.current_timestamp())
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/{COMMITS}/version={version}")
    for name, before in stale.items():
        _expire(spark, f"{root}/{name}", before)
    if version % FOLD_EVERY == 0:
        _expire(spark, f"{root}/{COMMITS}", version - FOLD_EVERY)
    return version


def _expire(spark: SparkSession, path: str, before: int) -> None:
    """Delete the versions below ``before`` of the table at ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(folder):
        name = found.getPath().getName()
        if name.startswith("version=") and int(name.removeprefix("version=")) < before:
            files.delete(found.getPath(), True)


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table at ``path``; None only if there is no such folder. Any other trouble is the caller's to know."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_commit(spark: SparkSession, root: str) -> Row | None:
    rows = _read(spark, f"{root}/{COMMITS}", COMMIT_ROW)
    return None if rows is None else rows.orderBy(F.desc("version")).first()


def latest_version(spark: SparkSession, root: str) -> int | None:
    last = latest_commit(spark, root)
    return None if last is None else last["version"]


def is_committed(spark: SparkSession, root: str, stream: str, batch: int) -> bool:
    """Has this micro-batch of this stream been committed? Its numbers rise."""
    last = latest_commit(spark, root)
    return last is not None and (last["streams"] or {}).get(stream, -1) >= batch


def _versions(spark: SparkSession, root: str, name: str, versions: Sequence[int]) -> DataFrame:
    """Just these versions of a table; no other folder is listed."""
    return spark.read.option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/version={v}" for v in versions])


def _folded(spark: SparkSession, root: str, name: str, fold: dict) -> DataFrame:
    base, key, changes = fold["base"], fold["key"], fold["changes"]
    if not changes:
        return _versions(spark, root, name, [base]).drop("version")
    rows = _versions(spark, root, name, [base, *changes])
    names = [c for c in rows.columns if c != "version"]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in names if c != key]), "version").alias("_last"))
    return last.select(*[c if c == key else F.col(f"_last.{c}") for c in names])


def read_latest(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table that every version rewrites or changes, as of the last commit."""
    last = latest_commit(spark, root)
    if last is None:
        return None
    fold = (last["folds"] or {}).get(name)
    return spark.read.parquet(f"{root}/{name}/version={last['version']}") if fold is None else _folded(spark, root, name, fold.asDict())


def read_appended(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame | None:
    """A table that versions add to: the rows of all committed versions, None if none has any."""
    last = latest_version(spark, root)
    if last is None:
        return None
    rows = _read(spark, f"{root}/{name}")
    upto = last if before is None else min(last, before - 1)
    return None if rows is None else rows.filter(F.col("version") <= upto).drop("version")


def read_since(
    spark: SparkSession, root: str, name: str, mark: int | None, upto: int | None = None
) -> tuple[DataFrame | None, int | None]:
    """Rows of the committed versions after ``mark`` (up to ``upto``) of a table that every version writes, and the last version."""
    last = latest_version(spark, root)
    last = last if last is None or upto is None else min(last, upto)
    first = 0 if mark is None else mark + 1
    if last is None or first > last:
        return None, mark if last is None else last
    return _versions(spark, root, name, range(first, last + 1)).drop("version"), last


def read_overlapping(spark: SparkSession, root: str, name: str, order: str, low: int, high: int) -> DataFrame | None:
    """Rows with ``order`` from ``low`` to ``high``; only versions whose span meets this range are read."""
    spans = read_latest(spark, root, SPANS) if latest_version(spark, root) is not None else None
    if spans is None:
        return None
    hit = sorted(r["at"] for r in spans.filter((F.col("low") <= high) & (F.col("high") >= low)).select("at").collect())
    return _versions(spark, root, name, hit).drop("version").filter(F.col(order).between(low, high)) if hit else None
