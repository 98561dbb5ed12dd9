"""Wallet analytics: positional index, dictionary codes, wallet-set trades, ranks and portfolios.

A wallet or a wallet set may hold a large part of all rows. Lists are therefore cut into pieces
of a fixed range of positions, and trade histories are walked in chunks of the sale position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.ordered import CHUNK, dense_index, exclusive_prefix
from ledgerweave.functions.scalars import percent
from ledgerweave.session import stored

PIECE = 4096


def sale_index(sales: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Sales with their position by (time, tx, asset)."""
    return dense_index(sales, ["ts", "tx", "asset"], keep=keep)


def mint_index(mints: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Mints with their position by (time, asset)."""
    return dense_index(mints.filter(F.col("payer").isNotNull()), ["ts", "asset"], keep=keep)


def wallet_links(states: DataFrame, mints: DataFrame, sales: DataFrame) -> DataFrame:
    """The index as one long table of (wallet, kind, position)."""
    held = states.filter((F.col("burned") == 0) & F.col("owner").isNotNull())
    pieces = [
        held.select(F.col("owner").alias("wallet"), F.lit("current").alias("kind"), F.col("number").alias("pos")),
        mints.select(F.col("payer").alias("wallet"), F.lit("mint").alias("kind"), F.col("idx").alias("pos")),
        sales.filter(F.col("buyer").isNotNull()).select(
            F.col("buyer").alias("wallet"), F.lit("buy").alias("kind"), F.col("idx").alias("pos")
        ),
        sales.filter(F.col("seller").isNotNull()).select(
            F.col("seller").alias("wallet"), F.lit("sell").alias("kind"), F.col("idx").alias("pos")
        ),
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def wallet_index(links: DataFrame, piece: int = PIECE) -> DataFrame:
    """Sorted position lists per wallet and kind.

    Positions are unique within a kind, so a piece holds at most ``piece`` of them; the pieces of
    a wallet in order are its whole list.
    """
    return (
        links.groupBy("wallet", "kind", F.expr(f"pos div {piece}").alias("piece"))
        .agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        .withColumn("n", F.size("positions").cast("bigint"))
    )


def wallet_places(sales: DataFrame, piece: int = PIECE) -> DataFrame:
    """Places of each wallet's buys and sells inside each range of sales, in pieces."""
    sides = F.array(*[F.struct(F.col(side).alias("wallet"), F.lit(kind).alias("kind")) for side, kind in (("buyer", "buy"), ("seller", "sell"))])
    seen = sales.select("rid", "place", F.inline(sides)).filter(F.col("wallet").isNotNull())
    lists = seen.groupBy("rid", "wallet", "kind", F.expr(f"place div {piece}").alias("_piece"))
    return lists.agg(F.sort_array(F.collect_list("place")).alias("places")).drop("_piece")


def placed_index(places: DataFrame, piece: int = PIECE) -> DataFrame:
    """``wallet_index`` from lists of places, each with the ``base`` of its range."""
    at = F.explode(F.transform("places", lambda p: p + F.col("base")))
    return wallet_index(places.select("wallet", "kind", at.alias("pos")), piece)


def assignment_rules(links: DataFrame, assets: Column, mints: Column, sales: Column) -> DataFrame:
    """Index checks: each held asset assigned once, positions in range, mint positions covered exactly.

    Distinct non-negative positions below ``n`` that number ``n`` are exactly ``0 .. n-1``.
    """
    counts = links.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("pos").alias("distinct_pos"),
        F.min("pos").alias("low"),
        F.max("pos").alias("high"),
    )
    sized = counts.withColumns({"_a": assets, "_m": mints, "_s": sales})
    universe = (
        F.when(F.col("kind") == "current", F.col("_a")).when(F.col("kind") == "mint", F.col("_m")).otherwise(F.col("_s"))
    )
    unique = F.col("n") == F.col("distinct_pos")
    in_range = (F.col("low") >= 0) & (F.col("high") < universe)
    return sized.select(
        "kind",
        "n",
        unique.alias("assigned_once"),
        in_range.alias("in_range"),
        (unique & in_range & (F.col("n") == universe)).alias("exact_cover"),
    )


def dict_encode(rows: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Code of each value by first appearance in ``order``."""
    firsts = rows.groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    return dense_index(firsts, ["_first"], "code").select(value, "code")


def dict_decode(code: Column, names: Sequence[str], default: str) -> Column:
    """Name of a code in a fixed list; unknown codes give ``default``."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), code.cast("int")), F.lit(default))


def benchmark_histogram(counts: DataFrame, kind: str = "kind", value: str = "n") -> DataFrame:
    """Descending benchmark vector in run-length form: value, repeats and rank of the first.

    A vector with total N has at most sqrt(2N) distinct values, so the window stays small even
    where the vector itself is large.
    """
    runs = counts.groupBy(kind, value).agg(F.count(F.lit(1)).alias("repeats"))
    before = Window.partitionBy(kind).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("first_rank", F.coalesce(F.sum("repeats").over(before), F.lit(0)) + 1)


def rank_against(benchmarks: DataFrame, amounts: DataFrame) -> DataFrame:
    """Rank of each amount in its benchmark: one more than the number of larger values.

    ``benchmarks``: (kind, value, repeats); ``amounts``: (kind, amount, ...). Distinct amounts are
    placed between the benchmark values by one sorted pass over the union, so there is no
    inequality join. An amount of zero or an empty benchmark has no rank.
    """
    values = benchmarks.select("kind", F.col("value").alias("amount"), F.col("repeats"))
    asked = amounts.filter(F.col("amount") > 0).select("kind", "amount").distinct()
    levels = (
        values.unionByName(asked.withColumn("repeats", F.lit(0).cast("bigint")))
        .groupBy("kind", "amount")
        .agg(F.sum("repeats").alias("repeats"))
    )
    larger = Window.partitionBy("kind").orderBy(F.desc("amount")).rowsBetween(Window.unboundedPreceding, -1)
    whole = values.groupBy("kind").agg(F.sum("repeats").alias("universe"))
    ranked = levels.select("kind", "amount", (F.coalesce(F.sum("repeats").over(larger), F.lit(0)) + 1).alias("rank"))
    return (
        amounts.join(ranked.join(whole, "kind"), ["kind", "amount"], "left")
        .withColumn("top_pct", F.col("rank").cast("double") / F.col("universe").cast("double") * 100.0)
    )


def set_trades(sales: DataFrame, sets: DataFrame, place: Sequence[str] = ("idx",)) -> DataFrame:
    """Trades seen from each wallet set: buy, sell, or internal when the set is on both sides.

    ``place``: columns that, with the asset and the time, name one sale; the position index or the transaction.
    """
    members = sets.select("set_id", "wallet").distinct()
    cols = [*place, "asset", "ts", "price"]
    one, none = F.lit(1), F.lit(0)
    bought = sales.join(members, sales["buyer"] == members["wallet"]).select(
        "set_id", *cols, one.alias("bought"), none.alias("sold")
    )
    sold = sales.join(members, sales["seller"] == members["wallet"]).select(
        "set_id", *cols, none.alias("bought"), one.alias("sold")
    )
    sides = (
        bought.unionByName(sold)
        .groupBy("set_id", *cols)
        .agg(F.max("bought").alias("bought"), F.max("sold").alias("sold"))
    )
    return sides.select(
        "set_id",
        *cols,
        F.when(F.col("bought") + F.col("sold") == 2, "internal")
        .when(F.col("bought") == 1, "buy")
        .otherwise("sell")
        .alias("kind"),
    )


def match_resales(trades: DataFrame, order: Sequence[str] = ("idx",), chunk: Column | None = None) -> DataFrame:
    """Add ``matched`` to the non-internal trades: the previous one of that asset was a buy.

    ``chunk`` rises with the first of the ``order`` columns and bounds what one task walks.
    """
    outside = trades.filter(F.col("kind") != "internal")
    placed = exclusive_prefix(
        outside,
        ["set_id", "asset"],
        list(order),
        F.expr(f"idx div {CHUNK}") if chunk is None else chunk,
        maxima={"_before": F.struct(*order, "kind")},
    )
    matched = (F.col("kind") == "buy") | F.coalesce(F.col("_before.kind") == "buy", F.lit(False))
    return placed.withColumn("matched", matched).drop("_before")


def market_flow(trades: DataFrame, matched: DataFrame) -> DataFrame:
    """Cash flow per set; amounts stay in base units."""
    buy, sell = F.col("kind") == "buy", F.col("kind") == "sell"
    amount = F.col("price").cast("decimal(20,0)")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, amount)), F.lit(0))
    flows = matched.groupBy("set_id").agg(
        F.count_if(buy).alias("purchases"),
        total(buy).alias("spent"),
        F.count_if(sell & F.col("matched")).alias("matched_resales"),
        total(sell & F.col("matched")).alias("received"),
        F.count_if(sell & ~F.col("matched")).alias("unmatched_sales"),
    )
    inside = trades.filter(F.col("kind") == "internal").groupBy("set_id").agg(F.count(F.lit(1)).alias("internal"))
    return (
        flows.join(inside, "set_id", "full_outer")
        .fillna(0)
        .withColumn("net", F.col("received") - F.col("spent"))
    )


def set_holdings(states: DataFrame, sets: DataFrame) -> DataFrame:
    """Unburned assets held by each set."""
    members = sets.select("set_id", "wallet").distinct()
    held = states.filter(F.col("burned") == 0)
    return held.join(members, held["owner"] == members["wallet"]).drop("wallet")


def open_trail(holdings: DataFrame, trades: DataFrame, order: Sequence[str] = ("idx",)) -> DataFrame:
    """Held assets without an open market purchase: the last outside trade is not a buy."""
    last = (
        trades.filter(F.col("kind") != "internal")
        .groupBy("set_id", "asset")
        .agg(F.max(F.struct(*order, "kind")).alias("_last"))
        .filter(F.col("_last.kind") == "buy")
    )
    return holdings.select("set_id", "asset").join(last.select("set_id", "asset"), ["set_id", "asset"], "left_anti")


def timeline(mints: DataFrame, matched: DataFrame, sets: DataFrame) -> DataFrame:
    """Mints, buys and sells of each set, newest first."""
    members = sets.select("set_id", "wallet").distinct()
    minted = mints.join(members, mints["payer"] == members["wallet"]).select(
        "set_id", F.lit("mint").alias("kind"), "ts", "asset", "phase", "idx", F.lit(None).cast("boolean").alias("matched")
    )
    traded = matched.select("set_id", "kind", "ts", "asset", F.lit(None).cast("string").alias("phase"), "idx", "matched")
    place = F.when(F.col("kind") == "mint", 0).otherwise(1)
    return minted.unionByName(traded).orderBy("set_id", F.desc("ts"), place, "idx")


def timeline_page(rows: DataFrame, set_id, size: int, kind: str | None = None) -> DataFrame:
    """The newest ``size`` entries of one set, optionally of one kind."""
    page = rows.filter(F.col("set_id") == set_id)
    if kind is not None:
        page = page.filter(F.col("kind") == kind)
    place = F.when(F.col("kind") == "mint", 0).otherwise(1)
    return page.orderBy(F.desc("ts"), place, "idx").limit(size)


def wallet_portfolio(
    holdings: DataFrame,
    mints: DataFrame,
    sets: DataFrame,
    active_supply: Column,
    bucket: Column,
    categories: Sequence[str],
    buckets: Sequence[str],
    phases: Sequence[str],
    mint_price: float,
) -> DataFrame:
    """Holdings, custody, category, bucket and mint figures per set.

    An asset has one owner and the member table is distinct, so plain counts are exact.
    """
    members = sets.select("set_id", "wallet").distinct()
    locked = F.col("locked") == 1
    held = holdings.withColumn("_bucket", bucket)
    figures = held.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if(locked).alias("locked"),
        F.min(F.when(locked, F.col("lock_ts"))).alias("oldest_lock"),
        F.max(F.when(locked, F.col("lock_ts"))).alias("newest_lock"),
        F.max(F.when(locked, F.col("activity_ts"))).alias("latest_activity"),
        *[F.count_if(F.col("category") == c).alias(f"category_{i}") for i, c in enumerate(categories)],
        *[F.count_if(F.col("_bucket") == b).alias(f"bucket_{i}") for i, b in enumerate(buckets)],
    )
    minted = mints.join(members, mints["payer"] == members["wallet"]).select("set_id", "asset", "phase")
    launches = minted.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("minted"),
        *[F.count_if(F.col("phase") == p).alias(f"phase_{i}") for i, p in enumerate(phases)],
    )
    originals = (
        holdings.select("set_id", "asset")
        .join(minted.select("set_id", "asset").distinct(), ["set_id", "asset"], "left_semi")
        .groupBy("set_id")
        .agg(F.count(F.lit(1)).alias("originals_held"))
    )
    counts = ["assets", "locked", "minted", "originals_held"]
    counts += [f"category_{i}" for i in range(len(categories))] + [f"bucket_{i}" for i in range(len(buckets))]
    counts += [f"phase_{i}" for i in range(len(phases))]
    return (
        members.select("set_id")
        .distinct()
        .join(figures, "set_id", "left")
        .join(launches, "set_id", "left")
        .join(originals, "set_id", "left")
        .fillna(0, subset=counts)
        .withColumn("_active", active_supply)
        .withColumn("locked_pct", percent(F.col("locked"), F.col("assets"), None))
        .withColumn("supply_pct", percent(F.col("assets"), F.col("_active"), None))
        .withColumn("mint_spend", F.col("minted").cast("double") * mint_price)
        .drop("_active")
    )
