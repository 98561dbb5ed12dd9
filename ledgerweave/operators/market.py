"""Sale ledger: merge, append, KPIs, monthly and daily activity, first resale, sale rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.histogram import fixed_histogram
from ledgerweave.functions.distinct import agg_distinct, distinct_count
from ledgerweave.functions.ordered import keep_first
from ledgerweave.functions.scalars import days_between, exact_sum, month_text, trimmed_number, units

# Resale buckets with their upper bound in days, and sale-row labels.
RESALE_BUCKETS = [("≤24h", 1), ("2–7d", 7), ("8–30d", 30), ("31–90d", 90), ("91–365d", 365)]
RESALE_LATE = ">1y"
RESALE_NEVER = "Never sold"
DIRECT_FAMILIES = {
    "Magic Eden V2": "Magic Eden v2",
    "Tensor Marketplace": "Tensor Marketplace",
    "Tensor AMM": "Tensor AMM",
}
ATTRIBUTION = "direct_program_live"
SALE_CLASS = "LIVE_DETECTED_SALE"


def merge_ledgers(base: DataFrame, live: DataFrame, keys: Sequence[str] = ("tx", "asset")) -> DataFrame:
    """All base rows plus the live rows whose key the base lacks, in one shuffle of both."""
    both = base.withColumn("_side", F.lit(0)).unionByName(live.withColumn("_side", F.lit(1)))
    first = F.min("_side").over(Window.partitionBy(*keys))
    return both.withColumn("_first", first).filter(F.col("_side") == F.col("_first")).drop("_side", "_first")


def append_new(ledger: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("tx", "asset")) -> DataFrame:
    """Ledger plus the rows it does not hold yet, one a key, in ledger order; the existing row wins."""
    rest = [c for c in fresh.columns if c not in keys]
    return merge_ledgers(ledger, keep_first(fresh, list(keys), rest), keys)


def market_kpis(sales: DataFrame, mint_proceeds: Column, price_places: int, royalty_places: int, dense: bool = False) -> DataFrame:
    """Sales, volume, buyers, assets sold and royalties of the first recipient; ``dense``: buyers and assets are dense codes.

    ``sales`` is read twice, so it should be a stored table.
    """
    figures = {"secondary_sales": F.count(F.lit(1)), "_volume": exact_sum(F.col("price")), "_royalty": exact_sum(F.col("royalty"))}
    totals = agg_distinct(sales, figures, F.col("buyer"), "unique_buyers", dense)
    totals = totals.withColumn("assets_ever_sold", distinct_count(sales, "asset", dense))
    royalties = units(F.col("_royalty"), royalty_places)
    return totals.select(
        "secondary_sales",
        units(F.col("_volume"), price_places).alias("secondary_volume"),
        "unique_buyers",
        "assets_ever_sold",
        royalties.alias("royalties"),
        (mint_proceeds + royalties).alias("mint_plus_royalties"),
    )


def period_activity(sales: DataFrame, period: Column, name: str, price_places: int, royalty_places: int) -> DataFrame:
    """Count, volume and royalties per period; periods without sales are absent."""
    return (
        sales.groupBy(period.alias(name))
        .agg(
            F.count(F.lit(1)).alias("sales"),
            exact_sum(F.col("price")).alias("_volume"),
            exact_sum(F.col("royalty")).alias("_royalty"),
        )
        .select(
            name,
            "sales",
            units(F.col("_volume"), price_places).alias("volume"),
            units(F.col("_royalty"), royalty_places).alias("royalties"),
        )
    )


def monthly_activity(sales: DataFrame, price_places: int, royalty_places: int) -> DataFrame:
    return period_activity(sales, month_text(F.col("ts")), "month", price_places, royalty_places)


def daily_activity(sales: DataFrame, price_places: int) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return period_activity(sales, day, "date", price_places, price_places).drop("royalties")


def resale_bucket(first_sale: Column, origin: Column) -> Column:
    elapsed = days_between(first_sale, origin)
    label = F.when(first_sale.isNull(), RESALE_NEVER)
    for text, limit in RESALE_BUCKETS:
        label = label.when(elapsed <= limit, text)
    return label.otherwise(RESALE_LATE)


def first_resale(assets: DataFrame, base: DataFrame, live: DataFrame) -> DataFrame:
    """Assets by time from origin to first sale.

    The distribution of the base ledger is kept; an asset never sold there that is sold later
    moves to the last bucket.
    """
    firsts = base.groupBy("asset").agg(F.min("ts").alias("first_ts"))
    later = live.select("asset").distinct().withColumn("later", F.lit(True))
    placed = assets.join(firsts, "asset", "left").join(later, "asset", "left")
    bucket = resale_bucket(F.col("first_ts"), F.col("origin"))
    label = F.when(F.col("first_ts").isNull() & F.col("later"), RESALE_LATE).otherwise(bucket)
    labels = [b for b, _ in RESALE_BUCKETS] + [RESALE_LATE, RESALE_NEVER]
    return fixed_histogram(placed, label, labels, "bucket", {"assets": F.lit(1)})


def direct_family(detail: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DIRECT_FAMILIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, detail), detail)


def sale_rows(sales: DataFrame, assets: DataFrame, places: int, royalty_places: int) -> DataFrame:
    """Ledger rows as text: asset number and name, derived dates, family, fixed labels and trimmed amounts.

    ``sales`` carries ``price``, ``royalty`` and ``royalty_second`` in base units, the marketplace, its detail and the
    price method; ``assets`` (asset, number, name) is one row an asset. A number that is none is kept as it is.
    """
    wide = lambda c, p: F.col(c).cast("decimal(38,9)") / F.lit(10**p).cast("decimal(20,0)")
    first, second = wide("royalty", royalty_places), wide("royalty_second", royalty_places)
    number = F.col("number").try_cast("double")
    whole = F.when(number.isNotNull(), number.cast("bigint").cast("string")).otherwise(F.col("number"))
    named = sales.join(assets.select("asset", "number", "name"), "asset", "left")
    return named.select(
        "tx",
        "asset",
        F.coalesce(whole, F.lit("")).alias("number"),
        F.coalesce("name", F.lit("")).alias("name"),
        "marketplace",
        F.col("method").alias("price_method"),
        F.lit("0").alias("price_recovered"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("block_time"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".000 UTC")).alias("utc"),
        F.date_format("ts", "yyyy-MM-dd").alias("sale_date"),
        F.date_format("ts", "yyyy-MM").alias("sale_month"),
        F.date_format("ts", "yyyy").alias("sale_year"),
        F.col("market").alias("marketplace_detail"),
        F.lit(ATTRIBUTION).alias("attribution_method"),
        direct_family(F.col("market")).alias("direct_program_families"),
        "buyer",
        "seller",
        trimmed_number(wide("price", places)).alias("gross_price"),
        F.lit(SALE_CLASS).alias("sale_class"),
        F.lit("0").alias("legacy_sale"),
        trimmed_number(first).alias("royalty_first"),
        trimmed_number(second).alias("royalty_second"),
        trimmed_number(first + second).alias("royalty_total"),
        F.when(F.col("royalty") + F.col("royalty_second") > 0, "1").otherwise("0").alias("royalty_paid"),
    )
