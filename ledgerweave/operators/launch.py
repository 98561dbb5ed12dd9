"""Launch summaries: public mints, phases and mints per minter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.distinct import agg_distinct
from ledgerweave.functions.scalars import iso_z

# Public mint price in units and phase labels in order.
MINT_PRICE = 1.5
PHASES = ["Phase I", "Phase II", "Phase III"]


def launch_kpis(mints: DataFrame, price: float = MINT_PRICE, dense: bool = False) -> DataFrame:
    """Supply and minters of the launch; ``dense`` says that payers are dense codes."""
    totals = agg_distinct(mints, {"public_mint_supply": F.count(F.lit(1))}, F.col("payer"), "unique_minters", dense)
    return totals.select(
        "public_mint_supply",
        "unique_minters",
        F.lit(price).alias("mint_price"),
        (F.col("public_mint_supply").cast("double") * price).alias("mint_proceeds"),
    )


def launch_phases(mints: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase")).cast("bigint")
    return (
        mints.groupBy("phase")
        .agg(
            F.count(F.lit(1)).alias("minted"),
            F.count_distinct("payer").alias("unique_minters"),
            iso_z(F.min("ts")).alias("first_mint"),
            iso_z(F.max("ts")).alias("last_mint"),
        )
        .withColumn("ord", order)
    )


def mint_distribution(mints: DataFrame) -> DataFrame:
    """How many minters minted how many."""
    per_minter = (
        mints.filter(F.col("payer").isNotNull()).groupBy("payer").agg(F.count(F.lit(1)).alias("assets_minted"))
    )
    return (
        per_minter.groupBy("assets_minted")
        .agg(F.count(F.lit(1)).alias("minters"))
        .withColumn("total_assets", F.col("assets_minted") * F.col("minters"))
    )
