"""Set operations on key tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watch_set(components: dict[str, DataFrame]) -> DataFrame:
    """Distinct union of one-column key frames, each key with the components it came from."""
    tagged = None
    for name, frame in components.items():
        part = frame.select(F.col(frame.columns[0]).cast("string").alias("key"), F.lit(name).alias("component"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.distinct()


def watch_counts(tagged: DataFrame) -> DataFrame:
    """Distinct keys per component and in the whole set."""
    parts = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("keys"))
    whole = tagged.agg(F.count_distinct("key").alias("keys")).select(F.lit("all").alias("component"), "keys")
    return parts.unionByName(whole)


def set_diff(target: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``missing`` from actual, or ``unexpected`` there."""
    sides = target.select(key, F.lit(1).alias("t"), F.lit(0).alias("a")).unionByName(
        actual.select(key, F.lit(0).alias("t"), F.lit(1).alias("a"))
    )
    return (
        sides.groupBy(key)
        .agg(F.max("t").alias("t"), F.max("a").alias("a"))
        .filter(F.col("t") != F.col("a"))
        .select(key, F.when(F.col("t") == 1, "missing").otherwise("unexpected").alias("side"))
    )


def set_intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides; expected to be empty after a release."""
    return a.select(key).intersect(b.select(key))


def discovered_union(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of (tx, key) finds with their source; the first row per (tx, key, source) stays."""
    out = None
    for name, frame in sources.items():
        part = frame.select("tx", "key", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["tx", "key", "source"])


def probe_coverage(probes: DataFrame, discovered: DataFrame) -> DataFrame:
    """Per source, how many known (key, tx) pairs it missed; a source with misses is dropped."""
    found = discovered.select("source", "key", "tx").withColumn("_hit", F.lit(1))
    return (
        probes.join(found, ["source", "key", "tx"], "left")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("_hit").isNull()).alias("missed"))
        .withColumn("usable", F.col("missed") == 0)
    )


def scan_complete(keys: DataFrame, done: str) -> DataFrame:
    return keys.agg(F.count(F.lit(1)).alias("seeded"), F.count_if(F.col(done) == 1).alias("done")).withColumn(
        "complete", F.col("seeded") == F.col("done")
    )


def gap_keys(introduced: DataFrame, activity: DataFrame, pending: DataFrame) -> DataFrame:
    """Activity of newly watched keys since their introduction that is not pending yet."""
    since = activity.join(introduced.select("key", "since_seq"), "key").filter(F.col("seq") > F.col("since_seq"))
    return since.select("key", "tx").distinct().join(pending.select("tx").distinct(), "tx", "left_anti")
