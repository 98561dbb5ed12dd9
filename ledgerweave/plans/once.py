"""Results that several queries share are built once for a session and the input files as they are."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

_BUILT: dict[tuple, str] = {}


def input_files(spark: SparkSession, sf_dir: str, tables: Sequence[str]) -> tuple:
    """Path, length and time of change of each file of the tables."""
    found = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)]
    return tuple(sorted(found))


def built_once(spark: SparkSession, sf_dir: str, tables: Sequence[str], build: Callable[[SparkSession, str], str]) -> str:
    """The folder that ``build`` writes from these tables; other or changed files make another one."""
    key = (spark.sparkContext.applicationId, build.__module__, build.__name__, input_files(spark, sf_dir, tables))
    if key not in _BUILT:
        _BUILT[key] = build(spark, sf_dir)
    return _BUILT[key]
