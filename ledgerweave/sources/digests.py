"""Versions that are compared by digest: equal tables without reading rows, changed ones by their unequal buckets.

A version's rows are dealt into buckets by a hash of their key. A bucket's digest is its number of rows and two sums of row
hashes, so it does not depend on order and adds up: ``FAN`` buckets sum to one node of the level above, and so on to one root.
The tree is stored with the version. Two versions are compared from the root down, and only children of unequal nodes are
looked at; the rows of unequal buckets alone are then read and joined. Versions must have the same number of buckets.

The sums hash all columns by name order, with two seeds; rows that differ in both without changing either sum would go
unnoticed, with a chance of about 2^-120. Buckets are folders, so their number is the caller's to bound; the tree has fewer
than 1.1 times as many rows, and the driver holds at most the numbers of unequal buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType

FAN = 16
BUCKETS = 256
BUCKET = "digest_bucket"
SEEDS = (11, 29)


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def bucket_digests(rows: DataFrame) -> DataFrame:
    """``bucket, n, s0, s1`` of rows that carry their bucket."""
    names = sorted(c for c in rows.columns if c != BUCKET)
    # A NULL leaves a row hash unchanged, so each field says whether it is one.
    fields = [x for c in names for x in (F.col(c), F.col(c).isNull())]
    sums = [F.sum(F.xxhash64(F.lit(seed), *fields).cast(DecimalType(20, 0))).alias(f"s{i}") for i, seed in enumerate(SEEDS)]
    return rows.groupBy(F.col(BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *sums)


def digest_tree(leaves: DataFrame, buckets: int) -> DataFrame:
    """All levels: ``level`` (0 for the buckets), ``bucket``, ``n`` and the sums; the last level has the one node 0."""
    sums = ["n", *[f"s{i}" for i in range(len(SEEDS))]]
    typed = lambda df: df.select("level", F.col("bucket").cast("int").alias("bucket"), *[F.col(c).cast(DecimalType(38, 0)).alias(c) for c in sums])
    level = typed(leaves.withColumn("level", F.lit(0)))
    tree, depth, width = level, 0, buckets
    while width > 1:
        depth, width = depth + 1, -(-width // FAN)
        level = typed(level.groupBy(F.expr(f"bucket div {FAN}").alias("bucket")).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("level", F.lit(depth)))
        tree = tree.unionByName(level)
    return tree


def write_digested(rows: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS) -> None:
    """Store a version of a table with its tree."""
    spark: SparkSession = rows.sparkSession
    dealt = rows.withColumn(BUCKET, _bucket(key, buckets))
    rows.limit(0).write.parquet(f"{path}/schema")  # a version without rows has no other file
    dealt.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/rows")
    digest_tree(bucket_digests(spark.read.schema(dealt.schema).parquet(f"{path}/rows")), buckets).coalesce(1).write.parquet(f"{path}/tree")


def unequal_buckets(spark: SparkSession, a: str, b: str) -> list[int]:
    """Buckets in which two versions differ, found from the root down; the rows stay unread."""
    left, right = (spark.read.parquet(f"{p}/tree") for p in (a, b))
    sums = [c for c in left.columns if c not in ("level", "bucket")]
    tops = [t.agg(F.max("level"), F.count_if(F.col("level") == 0)).first() for t in (left, right)]
    depth = max(t[0] if t[0] is not None else -1 for t in tops)
    nodes: list[int] | None = None
    for level in range(depth, -1, -1):
        pick = F.col("level") == level
        if nodes is not None:
            pick = pick & F.expr(f"bucket div {FAN}").isin(nodes)
        other = right.filter(pick).select("bucket", *[F.col(c).alias(f"_{c}") for c in sums])
        both = left.filter(pick).join(other, "bucket", "full_outer")
        differ = F.lit(False)
        for c in sums:
            differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        nodes = sorted(r["bucket"] for r in both.filter(differ).select("bucket").collect())
        if not nodes:
            return []
    return nodes or []


def version_rows(spark: SparkSession, path: str, buckets: Sequence[int]) -> DataFrame:
    """The rows of some buckets; the folders of the others are left out."""
    schema = spark.read.parquet(f"{path}/schema").schema.add(BUCKET, IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col(BUCKET).isin(list(buckets))).drop(BUCKET)


def version_changes(spark: SparkSession, a: str, b: str, key: Sequence[str]) -> DataFrame:
    """Keys that two versions do not agree on: ``added``, ``removed`` or ``changed`` from ``a`` to ``b``. Keys are unique."""
    buckets = unequal_buckets(spark, a, b)
    left, right = (version_rows(spark, p, buckets) for p in (a, b))
    rest = [c for c in left.columns if c not in key]
    side = lambda df, name: df.select(*key, F.struct(*rest).alias(name))
    both = side(left, "_a").join(side(right, "_b"), list(key), "full_outer")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*key, status.alias("status")).filter("status IS NOT NULL")
