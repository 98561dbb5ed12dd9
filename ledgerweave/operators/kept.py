"""Products that follow a batch: signed change rows, reference counts of members, and sums by group.

A batch brings sales that are new to the ledger, and for each changed asset its old row (sign -1) and its new one (+1). From
these follow

* ``sums``: counts and amounts by figure and group (day of sale, month of burn, category, tier, resale bucket). They add up,
  so a batch adds its own;
* ``members``: how often a holder, buyer, sold asset or instant of activity is referred to. A member whose number leaves or
  reaches zero changes a distinct count; a holder whose number moves leaves one tier and enters another;
* ``firsts``: the first sale of an asset. It only moves back in time, and takes the asset from one resale bucket to another.

The three are tables kept by change. A batch reads the entries that it touches and writes those alone; it reads neither the
ledger nor the states of other assets. Figures that depend on the clock are not stored: instants of activity are counted, and
the reader judges them as of its own instant.

Defined cases: a NULL owner, buyer, asset or category is no member and is in no group; a NULL amount counts as zero; sales
without a time are the group of the NULL day; an empty batch changes nothing; a batch that has been committed is not taken again.
A change that takes away what was never counted fails the batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions.histogram import fixed_histogram
from ledgerweave.functions.scalars import days_between, epoch_micros, percent, units
from ledgerweave.operators import holders as H
from ledgerweave.operators.market import RESALE_BUCKETS, RESALE_LATE, RESALE_NEVER, resale_bucket
from ledgerweave.operators.series import gap_filled_months
from ledgerweave.session import settled
from ledgerweave.sources.tables import ByChange, commit_version, is_committed, latest_version, read_latest

WIDE = "decimal(38,0)"
NEVER = "never"


def signed_changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Old rows of the changed assets with sign -1 and their new rows with +1."""
    added = after.withColumn("sign", F.lit(1))
    return added if before is None else before.withColumn("sign", F.lit(-1)).unionByName(added)


def _facts(rows: DataFrame, facts: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """``(name, item, value)`` for each fact ``(name, when, item, value)`` of each row, summed by name and item."""
    each = [F.when(when, F.struct(F.lit(name).alias("name"), item.alias("item"), value.cast(WIDE).alias("value"))) for name, when, item, value in facts]
    # Unmet facts are NULL structs.
    flat = rows.select(F.explode(F.array_compact(F.array(*each))).alias("_f")).select("_f.*")
    return flat.groupBy("name", "item").agg(F.sum("value").cast(WIDE).alias("value"))


def _state_facts(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    sign, whole = F.col("sign"), F.lit("")
    burned, locked = F.col("burned") == 1, F.col("locked") == 1
    sums = [
        ("assets", F.lit(True), whole, sign),
        ("active", ~burned, whole, sign),
        ("locked", locked, whole, sign),
        ("burned", burned, whole, sign),
        ("burns", burned & F.col("burn_ts").isNotNull(), F.date_format("burn_ts", "yyyy-MM-01"), sign),
        ("burned_in", burned & F.col("category").isNotNull(), F.col("category"), sign),
    ]
    instant = F.coalesce(epoch_micros(F.col("activity_ts")).cast("string"), F.lit(NEVER))
    members = [
        ("holder", ~burned & F.col("owner").isNotNull(), F.col("owner").cast("string"), sign),
        ("activity", locked, instant, sign),
    ]
    return _facts(changes, sums), _facts(changes, members)


def _sale_facts(sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    one, day = F.lit(1), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(""))
    amount = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = [("sales", F.lit(True), day, one), ("volume", F.lit(True), day, amount("price")), ("royalty", F.lit(True), day, amount("royalty"))]
    members = [(kind, F.col(c).isNotNull(), F.col(c).cast("string"), one) for kind, c in (("buyer", "buyer"), ("sold", "asset"))]
    return _facts(sales, sums), _facts(sales, members)


def _key() -> Column:
    return F.concat_ws("|", "name", "item")


def _moved(stored: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """Entries that ``deltas`` touches, with their number before and after."""
    deltas = deltas.withColumn("key", _key())
    old = F.lit(0).cast(WIDE)
    rows = deltas.withColumn("before", old)
    if stored is not None:
        found = stored.select("key", F.col("value").alias("_old"))
        rows = deltas.join(found, "key", "left").withColumn("before", F.coalesce("_old", old)).drop("_old")
    after = (F.col("before") + F.col("value")).cast(WIDE)
    return rows.withColumn("after", after)


def _counted(rows: DataFrame) -> DataFrame:
    wrong = F.concat(F.lit("taken away more often than counted: "), F.col("key"))
    return rows.withColumn("after", F.when(F.col("after") >= 0, F.col("after")).otherwise(F.raise_error(wrong)))


def _steps(name: str, group: Column, old: Column, new: Column) -> list[tuple[str, Column, Column, Column]]:
    """The entry leaves the group of its old number and enters that of its new one."""
    return [(name, old > 0, group, F.lit(-1)), (name, new > 0, group, F.lit(1))]


def _derived(moved: DataFrame) -> DataFrame:
    """Sums that follow from the members: distinct counts, and holders and supply of each tier."""
    old, new, holder = F.col("before"), F.col("after"), F.col("name") == "holder"
    facts = _steps("distinct", F.col("name"), old, new)
    for number, sign in ((old, -1), (new, 1)):
        tier = H.tier_of(number)
        held = holder & (number > 0)
        facts += [("tier_holders", held, tier, F.lit(sign)), ("tier_supply", held, tier, number * sign)]
    return _facts(moved, facts)


def _label(first: str, later: str) -> Column:
    label = resale_bucket(F.col(first), F.col("origin"))
    return F.when(F.col(first).isNull() & F.col(later), RESALE_LATE).otherwise(label)


def _first_moves(stored: DataFrame | None, sales: DataFrame) -> DataFrame:
    """First sale of each sold asset before and after the batch. Base rows set it; a live row says only that there was one."""
    instant = lambda c: F.col(c).cast("timestamp")
    sold = sales.filter(F.col("asset").isNotNull()).groupBy(F.col("asset").cast("string").alias("asset")).agg(
        F.min(F.when(F.col("opening"), instant("ts"))).alias("_first"), F.max(~F.col("opening")).alias("_later"), F.min(instant("origin")).alias("_origin")
    )
    if stored is None:
        known = sold.withColumns({"before": F.lit(None).cast("timestamp"), "was_later": F.lit(False), "origin": F.col("_origin")})
    else:
        had = stored.select("asset", F.col("first_ts").alias("before"), F.col("later").alias("was_later"), "origin")
        known = sold.join(had, "asset", "left").withColumn("was_later", F.coalesce("was_later", F.lit(False)))
        known = known.withColumn("origin", F.coalesce("origin", "_origin"))
    return known.select("asset", "origin", "before", "was_later", F.least("before", "_first").alias("first_ts"), (F.col("was_later") | F.col("_later")).alias("later"))


def refresh(
    spark: SparkSession,
    root: str,
    changes: DataFrame | None = None,
    sales: DataFrame | None = None,
    stream: str | None = None,
    batch: int | None = None,
) -> int | None:
    """Carry one batch into the tables at ``root``; returns the version.

    ``changes``: rows of ``signed_changes`` with asset, category, owner, burned, burn_ts, locked, activity_ts. ``sales``: rows new to
    the ledger with tx, asset, buyer, ts, price, royalty, the ``origin`` of the asset, and ``opening``: does it belong to the base ledger,
    whose distribution of first sales is kept?
    """
    last = latest_version(spark, root)
    if stream is not None and is_committed(spark, root, stream, batch):
        return last
    stored = {name: read_latest(spark, root, name) if last is not None else None for name in ("sums", "members", "firsts")}
    facts = []
    if changes is not None:
        facts.append(_state_facts(changes))
    if sales is not None:
        facts.append(_sale_facts(sales))
    if not facts:
        return last
    both = lambda i: reduce(DataFrame.unionByName, [f[i] for f in facts]).groupBy("name", "item").agg(F.sum("value").cast(WIDE).alias("value"))
    members = settled(_counted(_moved(stored["members"], both(1).filter("value <> 0"))))
    sums = both(0).unionByName(_derived(members))
    frames = {"members": ByChange(members.select("key", "name", "item", F.col("after").alias("value")), "key", "value <> 0")}
    # A first version holds all tables, so that each of them has a base.
    if sales is not None or last is None:
        none = "asset string, origin timestamp, before timestamp, was_later boolean, first_ts timestamp, later boolean"
        moves = settled(_first_moves(stored["firsts"], sales)) if sales is not None else spark.createDataFrame([], none)
        buckets = [("resale", F.col("before").isNotNull() | F.col("was_later"), _label("before", "was_later"), F.lit(-1))]
        buckets += [("resale", F.col("first_ts").isNotNull() | F.col("later"), _label("first_ts", "later"), F.lit(1))]
        sums = sums.unionByName(_facts(moves, buckets))
        changed = moves.filter(~(F.col("before").eqNullSafe(F.col("first_ts")) & (F.col("was_later") == F.col("later"))))
        frames["firsts"] = ByChange(changed.select("asset", "origin", "first_ts", "later"), "asset")
    total = sums.groupBy("name", "item").agg(F.sum("value").cast(WIDE).alias("value")).filter("value <> 0")
    moved = _moved(stored["sums"], total)
    frames["sums"] = ByChange(moved.select("key", "name", "item", F.col("after").alias("value")), "key", "value <> 0")
    return commit_version(spark, root, frames, stream, batch)


def _entries(spark: SparkSession, root: str, table: str, *names: str) -> DataFrame:
    """Entries of these names; rows are stored in the order of name and item, so others are passed over."""
    return read_latest(spark, root, table).filter(F.col("name").isin(*names) & (F.col("value") != 0)).drop("key")


def _figures(spark: SparkSession, root: str, **wanted: tuple[str, str]) -> DataFrame:
    """One row: each figure from the entry ``(name, item)`` of the sums."""
    rows = _entries(spark, root, "sums", *{name for name, _ in wanted.values()})
    pick = lambda n, i: F.coalesce(F.max(F.when((F.col("name") == n) & (F.col("item") == i), F.col("value"))), F.lit(0))
    return rows.agg(*[pick(*place).cast("bigint").alias(alias) for alias, place in wanted.items()])


def _instants(spark: SparkSession, root: str) -> DataFrame:
    """Instants of the last activity of locked assets (NULL: never) with the number of assets."""
    at = F.timestamp_micros(F.col("item").try_cast("bigint"))
    return _entries(spark, root, "members", "activity").select(at.alias("activity_ts"), F.col("value").cast("bigint").alias("n"))


def kept_state_kpis(spark: SparkSession, root: str, as_of: Column) -> DataFrame:
    """As ``holders.state_kpis`` over all states."""
    one = _figures(spark, root, active_supply=("active", ""), holders=("distinct", "holder"), locked_assets=("locked", ""), burned=("burned", ""))
    age = days_between(F.col("_as_of"), F.col("activity_ts"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    ages = _instants(spark, root).withColumn("_as_of", as_of).agg(
        total(age <= H.ACTIVE_DAYS).alias("active_30d"), total(F.col("activity_ts").isNull() | (age > H.DORMANT_DAYS)).alias("dormant_1y")
    )
    shares = percent(F.col("locked_assets"), F.col("active_supply"))
    # One row on each side.
    named = ["active_supply", "locked_assets", "active_30d", "dormant_1y", "burned", "holders"]
    return one.withColumns({c: ages.select(c).scalar() for c in ages.columns}).select(*named, shares.alias("locked_pct"))


def kept_holder_balances(spark: SparkSession, root: str) -> DataFrame:
    """As ``holders.holder_balances``; the owner is text."""
    return _entries(spark, root, "members", "holder").select(F.col("item").alias("owner"), F.col("value").cast("bigint").alias("assets"))


def kept_holder_tiers(spark: SparkSession, root: str) -> DataFrame:
    rows = _entries(spark, root, "sums", "tier_holders", "tier_supply")
    of = lambda name: F.when(F.col("name") == name, F.col("value")).otherwise(F.lit(0))
    tiers = fixed_histogram(rows, F.col("item"), [t for t, _, _ in H.TIERS], "tier", {"holder_count": of("tier_holders"), "supply": of("tier_supply")})
    active = _figures(spark, root, active=("active", "")).scalar()
    return tiers.withColumn("_active", active).select("ord", "tier", "holder_count", "supply", percent(F.col("supply"), F.col("_active")).alias("supply_pct"))


def kept_activity_buckets(spark: SparkSession, root: str, as_of: Column) -> DataFrame:
    placed = _instants(spark, root).withColumn("_as_of", as_of)
    return fixed_histogram(placed, H.activity_bucket(F.lit(1), F.col("activity_ts"), F.col("_as_of")), H.ACTIVITY_LABELS, "bucket", {"assets": F.col("n")})


def kept_burned_by_category(spark: SparkSession, root: str, categories: list[str]) -> DataFrame:
    return fixed_histogram(_entries(spark, root, "sums", "burned_in"), F.col("item"), categories, "category", {"burned": F.col("value")})


def kept_burn_history(spark: SparkSession, root: str, as_of: Column) -> DataFrame:
    monthly = _entries(spark, root, "sums", "burns").select(F.col("item").alias("month"), F.col("value").cast("bigint").alias("monthly_burns"))
    bounds = monthly.agg(F.min("month").cast("date").alias("first")).withColumn("last", as_of.cast("date"))
    return gap_filled_months(monthly, bounds, {"monthly_burns": "total_burns"})


def _by_period(spark: SparkSession, root: str, width: int) -> DataFrame:
    """Sales, volume and royalty of each period named by the first ``width`` characters of a day."""
    period = F.when(F.col("item") != "", F.substring("item", 1, width)).alias("_period")
    of = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0)).alias(f"_{name}")
    return _entries(spark, root, "sums", "sales", "volume", "royalty").groupBy(period).agg(of("sales"), of("volume"), of("royalty"))


def kept_monthly_activity(spark: SparkSession, root: str, price_places: int, royalty_places: int) -> DataFrame:
    return _by_period(spark, root, 7).select(
        F.concat("_period", F.lit("-01")).alias("month"),
        F.col("_sales").cast("bigint").alias("sales"),
        units(F.col("_volume"), price_places).alias("volume"),
        units(F.col("_royalty"), royalty_places).alias("royalties"),
    )


def kept_daily_activity(spark: SparkSession, root: str, price_places: int) -> DataFrame:
    days = _by_period(spark, root, 10)
    return days.select(F.col("_period").alias("date"), F.col("_sales").cast("bigint").alias("sales"), units(F.col("_volume"), price_places).alias("volume"))


def kept_market_kpis(spark: SparkSession, root: str, mint_proceeds: Column, price_places: int, royalty_places: int) -> DataFrame:
    """As ``market.market_kpis`` over the whole ledger."""
    people = _figures(spark, root, buyers=("distinct", "buyer"), sold=("distinct", "sold"))
    totals = _by_period(spark, root, 0).agg(*[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(f"_{c}") for c in ("sales", "volume", "royalty")])
    royalties = units(F.col("_royalty"), royalty_places)
    return totals.select(
        F.col("_sales").cast("bigint").alias("secondary_sales"),
        units(F.col("_volume"), price_places).alias("secondary_volume"),
        people.select("buyers").scalar().alias("unique_buyers"),
        people.select("sold").scalar().alias("assets_ever_sold"),
        royalties.alias("royalties"),
        (mint_proceeds + royalties).alias("mint_plus_royalties"),
    )


def kept_first_resale(spark: SparkSession, root: str) -> DataFrame:
    """As ``market.first_resale``: assets of the state that no sale names were never sold."""
    rows = _entries(spark, root, "sums", "resale", "assets")
    sold = F.col("name") == "resale"
    placed = rows.select(F.when(sold, F.col("item")).otherwise(RESALE_NEVER).alias("item"), "value")
    placed = placed.unionByName(rows.filter(sold).select(F.lit(RESALE_NEVER).alias("item"), (-F.col("value")).alias("value")))
    labels = [b for b, _ in RESALE_BUCKETS] + [RESALE_LATE, RESALE_NEVER]
    return fixed_histogram(placed, F.col("item"), labels, "bucket", {"assets": F.col("value")})
