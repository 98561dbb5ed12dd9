"""Products of the asset-state table: KPIs, holders, tiers, activity buckets, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.distinct import agg_distinct
from ledgerweave.functions.histogram import fixed_histogram
from ledgerweave.functions.scalars import days_between, percent

# Holder tiers, activity buckets with their upper bound in days, and edge labels.
TIERS = [("1-4", 1, 4), ("5-14", 5, 14), ("15-29", 15, 29), ("30-49", 30, 49), ("50-99", 50, 99), ("100+", 100, None)]
ACTIVITY_BUCKETS = [
    ("Active 0–7d", 7),
    ("Idle 8–30d", 30),
    ("Idle 31–90d", 90),
    ("Idle 91–180d", 180),
    ("Idle 181–365d", 365),
]
ACTIVITY_OLD = "Idle 1+ year"
ACTIVITY_NEVER = "Never quested"
NOT_LOCKED = "Not staked"
ACTIVITY_LABELS = [b for b, _ in ACTIVITY_BUCKETS] + [ACTIVITY_OLD, ACTIVITY_NEVER]
ACTIVE_DAYS, DORMANT_DAYS = 30, 365


def activity_bucket(locked: Column, activity: Column, as_of: Column) -> Column:
    """Age of the last activity of a locked asset; NULL for an unlocked one."""
    age = days_between(as_of, activity)
    label = F.when(activity.isNull(), ACTIVITY_NEVER)
    for text, limit in ACTIVITY_BUCKETS:
        label = label.when(age <= limit, text)
    return F.when(locked == 1, label.otherwise(ACTIVITY_OLD))


def state_kpis(states: DataFrame, as_of: Column, dense: bool = False) -> DataFrame:
    """Supply, holders and lock figures; ``dense`` says that owners are dense codes."""
    burned, locked = F.col("burned") == 1, F.col("locked") == 1
    age = days_between(F.col("_as_of"), F.col("activity_ts"))
    dormant = F.col("activity_ts").isNull() | (age > DORMANT_DAYS)
    figures = {
        "active_supply": F.count_if(~burned),
        "locked_assets": F.count_if(locked),
        "active_30d": F.count_if(locked & (age <= ACTIVE_DAYS)),
        "dormant_1y": F.count_if(locked & dormant),
        "burned": F.count_if(burned),
    }
    one = agg_distinct(states.withColumn("_as_of", as_of), figures, F.when(~burned, F.col("owner")), "holders", dense)
    return one.withColumn("locked_pct", percent(F.col("locked_assets"), F.col("active_supply")))


def holder_balances(states: DataFrame) -> DataFrame:
    held = states.filter((F.col("burned") == 0) & F.col("owner").isNotNull())
    return held.groupBy("owner").agg(F.count(F.lit(1)).alias("assets"))


def tier_of(balance: Column) -> Column:
    label = F.lit(None).cast("string")
    for text, low, high in reversed(TIERS):
        inside = balance >= low if high is None else balance.between(low, high)
        label = F.when(inside, text).otherwise(label)
    return label


def holder_tiers(states: DataFrame) -> DataFrame:
    """Count-of-counts in fixed tiers with supply and share of the active supply."""
    active = states.agg(F.count_if(F.col("burned") == 0)).scalar()
    tiers = fixed_histogram(
        holder_balances(states),
        tier_of(F.col("assets")),
        [t for t, _, _ in TIERS],
        "tier",
        {"holder_count": F.lit(1), "supply": F.col("assets")},
    )
    return tiers.withColumn("_active", active).select(
        "ord", "tier", "holder_count", "supply", percent(F.col("supply"), F.col("_active")).alias("supply_pct")
    )


def activity_buckets(states: DataFrame, as_of: Column) -> DataFrame:
    placed = states.withColumn("_as_of", as_of)
    label = activity_bucket(F.col("locked"), F.col("activity_ts"), F.col("_as_of"))
    return fixed_histogram(placed, label, ACTIVITY_LABELS, "bucket", {"assets": F.lit(1)})


def burned_by_category(states: DataFrame, categories: Sequence[str]) -> DataFrame:
    burned = states.filter(F.col("burned") == 1)
    return fixed_histogram(burned, F.col("category"), categories, "category", {"burned": F.lit(1)})


def share_of_total(rows: DataFrame, part: str, name: str) -> DataFrame:
    """Share of each row in the column total, unrounded; zero when the total is zero."""
    total = rows.agg(F.sum(part)).scalar()
    return (
        rows.withColumn("_total", total)
        .withColumn(name, percent(F.col(part), F.col("_total"), None))
        .drop("_total")
    )


def top_holders(balances: DataFrame, limit: int = 10) -> DataFrame:
    """The largest holders; equal balances share a rank and the next rank skips."""
    head = balances.orderBy(F.desc("assets"), F.asc("owner")).limit(limit)
    # The window runs over the limited rows only.
    rank = F.rank().over(Window.orderBy(F.desc("assets"))).cast("bigint")
    return head.select(rank.alias("rank"), "owner", "assets")


def category_lookup(rows: DataFrame, dimension: DataFrame, key: str = "asset") -> DataFrame:
    """Attach the category; every row must have one, so a missing match raises."""
    joined = rows.join(dimension.withColumn("_hit", F.lit(True)), key, "left")
    checked = F.when(
        F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no category for "), F.col(key).cast("string")))
    ).otherwise(F.col("category"))
    return joined.withColumn("category", checked).drop("_hit")


def asset_listing(
    states: DataFrame,
    as_of: Column,
    categories: Sequence[str],
    category: str | None = None,
    locked: bool | None = None,
    sort: str = "number",
) -> DataFrame:
    """Filtered listing in one of three orders: number, rarest category first, or locked first."""
    rows = states
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    if locked is not None:
        rows = rows.filter(F.col("locked") == (1 if locked else 0))
    rank = F.array_position(F.array(*[F.lit(c) for c in reversed(categories)]), F.col("category"))
    rows = rows.withColumn("_as_of", as_of).select(
        "number",
        "category",
        rank.cast("bigint").alias("category_rank"),
        "locked",
        F.coalesce(
            activity_bucket(F.col("locked"), F.col("activity_ts"), F.col("_as_of")), F.lit(NOT_LOCKED)
        ).alias("bucket"),
        F.coalesce(F.date_format("activity_ts", "yyyy-MM-dd"), F.lit("")).alias("last_activity"),
    )
    order = {
        "number": [F.asc("number")],
        "category": [F.asc("category_rank"), F.asc("number")],
        "activity": [F.desc("locked"), F.asc("last_activity"), F.asc("number")],
    }[sort]
    return rows.orderBy(*order)


def recon_summary(states: DataFrame) -> DataFrame:
    """Recount after replay: here a lock counts only for an unburned asset."""
    alive = F.col("burned") == 0
    return states.agg(
        F.sum("burned").alias("burned"),
        (F.count(F.lit(1)) - F.sum("burned")).alias("active"),
        F.coalesce(F.sum(F.when(alive, F.col("locked"))), F.lit(0)).alias("locked"),
        F.count_distinct(F.when(alive, F.col("owner"))).alias("holders"),
    )


def key_frontier(states: DataFrame) -> DataFrame:
    """Active assets and the distinct owners among them; a missing owner is counted for refusal."""
    active = states.filter(F.col("burned") == 0)
    return active.agg(
        F.count(F.lit(1)).alias("active_assets"),
        F.count_distinct("owner").alias("owners"),
        F.count_if(F.col("owner").isNull()).alias("ownerless"),
    )


def active_owners(states: DataFrame) -> DataFrame:
    return states.filter((F.col("burned") == 0) & F.col("owner").isNotNull()).select("owner").distinct()
