"""Data-quality rules and regression checks. A rule row is (rule, left, right, ok)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Metrics of the change report with the smallest increase worth reporting;
# None means any difference.
MATERIAL = {
    "burned": 0.0,
    "active_supply": None,
    "floor": None,
    "secondary_sales": 0.0,
    "secondary_volume": 0.0005,
    "listed_count": None,
    "locked_assets": None,
    "holders": None,
    "assets_ever_sold": 0.0,
    "unique_buyers": 0.0,
    "royalties": 0.0005,
    "total_sold": 0.0005,
    "total_purchased": 0.005,
}
PERCENT_METRICS = ["floor"]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def orphan_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct child keys without a parent, with the number of rows that carry them."""
    return (
        child.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(parent.select(key).distinct(), key, "left_anti")
    )


def scalar(df: DataFrame, value: Column) -> Column:
    """An aggregate of ``df`` as one double value."""
    return df.agg(value.cast("double")).scalar()


def rule_report(spark: SparkSession, rules: Sequence[tuple[str, Column, Column, float]]) -> DataFrame:
    """Equality rules between single values, each within its tolerance."""
    line = spark.range(1).select(
        *[x for i, (_, a, b, _) in enumerate(rules) for x in (a.alias(f"_a{i}"), b.alias(f"_b{i}"))]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col(f"_a{i}").cast("double").alias("left"),
                F.col(f"_b{i}").cast("double").alias("right"),
                F.lit(float(tolerance)).alias("_tol"),
            )
            for i, (name, _, _, tolerance) in enumerate(rules)
        ]
    )
    close = F.coalesce(F.abs(F.col("left") - F.col("right")) <= F.col("_tol"), F.lit(False))
    return line.select(F.inline(cells)).withColumn("ok", close).drop("_tol")


def unpivot_row(row: DataFrame) -> DataFrame:
    """One-row frame of numbers to (metric, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.inline(cells))


def monotone(before: DataFrame, after: DataFrame, falling: Sequence[str], slack: float = 1e-9) -> DataFrame:
    """Metrics that may only rise, or only fall, against a baseline."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric")
    down = F.col("metric").isin(list(falling))
    ok = F.when(down, F.col("after") <= F.col("before") + slack).otherwise(F.col("after") + slack >= F.col("before"))
    return both.withColumn("ok", ok)


def non_decreasing(series: DataFrame, order: str, value: str) -> DataFrame:
    """Does a published calendar series never fall? One row per period, so one small window."""
    prev = F.lag(value).over(Window.orderBy(order))
    steps = series.withColumn("_prev", prev)
    return steps.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(value) < F.col("_prev"), F.lit(False))).alias("falls")
    ).withColumn("ok", F.col("falls") == 0)


def close_values(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    both = a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full_outer")
    ok = F.coalesce(F.abs(F.col("left") - F.col("right")) <= F.lit(tolerance), F.lit(False))
    return both.withColumn("ok", ok)


def age_rule(rows: DataFrame, name: str, at: str, now: Column, max_hours: float) -> DataFrame:
    """Instants must not lie in the future nor be older than the limit."""
    hours = (F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(3_600_000_000.0)
    return rows.withColumn("_now", now).select(
        name,
        hours.alias("age_hours"),
        F.when(hours < 0, "future").when(hours > max_hours, "stale").otherwise("ok").alias("status"),
    )


def golden_compare(golden: DataFrame, current: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Golden metrics against current ones by (group, metric); a metric on one side only fails."""
    g = golden.withColumnRenamed("value", "golden")
    c = current.withColumnRenamed("value", "current")
    ok = F.coalesce(F.abs(F.col("golden") - F.col("current")) <= F.lit(tolerance), F.lit(False))
    return g.join(c, ["group", "metric"], "full_outer").withColumn("ok", ok)


def checkpoint_rules(row: DataFrame, cutover: str, domains: Sequence[str], snapshot: str) -> DataFrame:
    """Every domain checkpoint is at or after the cutover and not later than the snapshot."""
    cells = F.array(
        *[
            F.struct(
                F.lit(d).alias("domain"),
                (F.col(d) >= F.col(cutover)).alias("after_cutover"),
                (F.col(d) <= F.col(snapshot)).alias("within_snapshot"),
            )
            for d in domains
        ]
    )
    return row.select(F.inline(cells))


def kpi_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Material changes between two KPI sets; supply is left out when burns explain it."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric")
    moved = both.withColumn("delta", F.col("after") - F.col("before"))
    limits = F.create_map(*[x for k, v in MATERIAL.items() for x in (F.lit(k), F.lit(v).cast("double"))])
    limit = F.try_element_at(limits, F.col("metric"))
    # At most one row per metric of the fixed list reaches this window.
    burned = F.max(F.when(F.col("metric") == "burned", F.col("delta"))).over(Window.partitionBy(F.lit(1)))
    known = moved.filter(F.col("metric").isin(list(MATERIAL))).withColumn("_burned", F.coalesce(burned, F.lit(0.0)))
    explained = (F.col("metric") == "active_supply") & (F.col("delta") == -F.col("_burned"))
    material = F.when(limit.isNull(), (F.col("delta") != 0) & ~explained).otherwise(F.col("delta") > limit)
    pct = F.when(
        F.col("metric").isin(PERCENT_METRICS) & (F.col("before") > 0), F.col("delta") / F.col("before") * 100.0
    )
    return known.filter(material).select("metric", "before", "after", "delta", pct.alias("percent"))
