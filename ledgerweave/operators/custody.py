"""Movements and calls of a batch: cursor gate, custody matching, unresolved cases, counters.

Movement rows: tx, seq, ts, asset, class, from_owner, to_owner, burn_ok.
Call rows: tx, seq, ts, pos, action, caller, wallet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.ordered import keep_first

# Movement classes, call actions and gate outcomes.
TRANSFER, SENT, RECEIVED = "TRANSFER", "BURN_OR_SEND_TO_ZERO", "MINT_OR_RECEIVE_FROM_ZERO"
LOCK, UNLOCK, RESTART = "LOCK", "UNLOCK", "RESTART"
APPLY, COVERED, DUPLICATE, STALE = "APPLY", "COVERED_PRE_ACTIVATION", "DUPLICATE", "STALE"
CONFLICT = "CONFLICT"
OVERLAP_SECONDS = 300


def cursor_gate(moves: DataFrame, cursors: DataFrame, activation: Column) -> DataFrame:
    """Status of each movement against the last one applied to its asset.

    The batch moves the cursor as well: an asset without one is covered by the activation instant only until the first
    movement in (seq, tx) order that is later than it; from then on every movement applies, whatever its time.
    """
    seen = cursors.select("asset", F.col("last_seq").alias("_seq"), F.col("last_tx").alias("_tx"))
    opened = moves.filter(F.col("ts") > activation).groupBy("asset").agg(F.min(F.struct("seq", "tx")).alias("_open"))
    before = F.col("_open").isNull() | (F.struct("seq", "tx") < F.col("_open"))
    status = (
        F.when(F.col("_seq").isNull() & (F.col("ts") <= activation) & before, COVERED)
        .when(F.col("_seq").isNull(), APPLY)
        .when(F.col("seq") < F.col("_seq"), STALE)
        .when((F.col("seq") == F.col("_seq")) & (F.col("tx") == F.col("_tx")), DUPLICATE)
        .when(F.col("seq") == F.col("_seq"), CONFLICT)
        .otherwise(APPLY)
    )
    known = moves.join(seen, "asset", "left").join(opened, "asset", "left")
    return known.withColumn("status", status).drop("_seq", "_tx", "_open")


def conflicts(gated: DataFrame) -> DataFrame:
    """Assets with two transactions at one sequence number, in the batch or against the cursor."""
    against = gated.filter(F.col("status") == CONFLICT).select("asset", "seq")
    inside = (
        gated.filter(F.col("status") == APPLY)
        .groupBy("asset", "seq")
        .agg(F.min("tx").alias("a"), F.max("tx").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select("asset", "seq")
    )
    return against.unionByName(inside).distinct()


def _directed(calls: DataFrame) -> DataFrame:
    """Lock and unlock calls with the movement direction each of them requires."""
    lock = F.col("action") == LOCK
    return calls.filter(F.col("action").isin(LOCK, UNLOCK) & F.col("wallet").isNotNull()).select(
        "*",
        F.when(lock, F.col("caller")).otherwise(F.col("wallet")).alias("from_owner"),
        F.when(lock, F.col("wallet")).otherwise(F.col("caller")).alias("to_owner"),
    )


def match_custody(moves: DataFrame, calls: DataFrame) -> DataFrame:
    """Attach to each transfer the first call of its transaction whose direction it follows.

    The direction turns the either-or condition into plain key equality, and the calls are
    reduced to one per key before the join, so no movement is multiplied.
    """
    keys = ["tx", "from_owner", "to_owner"]
    first = (
        _directed(calls)
        .groupBy(*keys)
        .agg(F.min(F.struct("pos", "action", "caller", "wallet")).alias("_c"))
        .select(
            *keys,
            F.lit(TRANSFER).alias("class"),
            F.col("_c.action").alias("matched"),
            F.col("_c.caller").alias("caller"),
            F.col("_c.wallet").alias("wallet"),
        )
    )
    return moves.join(first, [*keys, "class"], "left").select(*moves.columns, "matched", "caller", "wallet")


def unmatched_calls(calls: DataFrame, matched: DataFrame) -> DataFrame:
    """Lock and unlock calls that no movement of their transaction was matched with."""
    keys = ["tx", "action", "caller", "wallet"]
    used = matched.filter(F.col("matched").isNotNull()).select("tx", F.col("matched").alias("action"), "caller", "wallet")
    asked = calls.filter(F.col("action").isin(LOCK, UNLOCK))
    hit = asked.join(used.distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return hit.filter(F.col("_hit").isNull()).select(*calls.columns)


def call_links(calls: DataFrame, moves: DataFrame) -> DataFrame:
    """Every call with the assets its transaction moved in the required direction.

    A list holds what one transaction moved, which its own size limits.
    """
    keys = ["tx", "from_owner", "to_owner"]
    moved = moves.filter(F.col("class") == TRANSFER).select(*keys, "asset")
    ident = ["tx", "pos", "action", "caller", "wallet"]
    linked = (
        _directed(calls)
        .join(moved, keys)
        .groupBy(*ident)
        .agg(F.sort_array(F.collect_list("asset")).alias("assets"))
    )
    hit = calls.select(*ident).join(linked.select("tx", "pos", "assets"), ["tx", "pos"], "left")
    return hit.withColumn("assets", F.coalesce("assets", F.array().cast(linked.schema["assets"].dataType)))


def action_usage(links: DataFrame) -> DataFrame:
    return links.groupBy("action").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.size("assets")).cast("bigint").alias("linked_assets"),
        F.count_distinct("caller").alias("users"),
    )


def sales_by_movement(sales: DataFrame, moves: DataFrame, moved: bool) -> DataFrame:
    """Sales whose transaction moved the asset, or those it did not move."""
    pairs = moves.select("tx", "asset")
    return sales.join(pairs, ["tx", "asset"], "left_semi" if moved else "left_anti")


def unresolved(
    matched: DataFrame, calls: DataFrame, sales: DataFrame, vaults: Sequence[str] = (), unmoved: DataFrame | None = None
) -> DataFrame:
    """One row per case the reducer must not guess: (tx, asset, reason); any row stops the batch.

    Only deposits in a vault are looked up among the sales. ``unmoved``: the sales without a movement, if they are known.
    """
    cls = F.col("class")
    one_way = F.col("from_owner").isNull() | F.col("to_owner").isNull()
    deposit = (cls == TRANSFER) & ~one_way & F.col("to_owner").isin(list(vaults))
    sold = sales.select("tx", "asset")
    case = lambda rows, reason: rows.select("tx", F.col("asset").cast("string").alias("asset"), reason.alias("reason"))
    reason = (
        F.when((cls == TRANSFER) & one_way, "ambiguous transfer")
        .when((cls == SENT) & ~F.col("burn_ok"), "sent without burn instruction")
        .when((cls == SENT) & F.col("from_owner").isNull(), "ambiguous burn source")
        .when(cls == RECEIVED, "received from zero")
    )
    moved = case(matched, reason).filter(F.col("reason").isNotNull())
    unsold = case(matched.filter(deposit).join(sold, ["tx", "asset"], "left_anti"), F.lit("vault deposit without sale"))
    followed = matched.filter((cls == TRANSFER) & ~one_way & F.col("matched").isNotNull())
    usable = followed.filter(~deposit).unionByName(followed.filter(deposit).join(sold, ["tx", "asset"], "left_semi").select(*matched.columns))
    lone = unmatched_calls(calls, usable).select(
        "tx",
        F.lit(None).cast("string").alias("asset"),
        F.concat(F.lower("action"), F.lit(" call without movement")).alias("reason"),
    )
    unmoved = sales_by_movement(sales, matched, moved=False) if unmoved is None else unmoved
    return moved.unionByName(unsold).unionByName(lone).unionByName(case(unmoved, F.lit("sale without movement")))


def batch_counters(gated: DataFrame, calls: DataFrame, sales: DataFrame, updates: Column | None = None) -> DataFrame:
    """Counts per gate status, call action, applied class and applied custody action."""
    applied = gated.filter(F.col("status") == APPLY)
    named = lambda prefix, col: F.concat(F.lit(prefix), F.col(col)).alias("counter")
    labels = (
        gated.select(named("MOVEMENT_", "status"))
        .unionByName(calls.select(named("CALL_", "action")))
        .unionByName(applied.select(F.when(F.col("class") == TRANSFER, "TRANSFER").otherwise("BURN").alias("counter")))
        .unionByName(applied.filter(F.col("matched").isNotNull()).select(named("ASSET_", "matched")))
        .unionByName(sales.select(F.lit("SALE").alias("counter")))
    )
    counts = labels.groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
    if updates is None:
        return counts
    row = gated.sparkSession.range(1).select(F.lit("RESTART_ASSET_UPDATES").alias("counter"), updates.alias("n"))
    return counts.unionByName(row)


def overlap_replay(rows: DataFrame, checkpoint: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Read from a little before the checkpoint, drop what it covers, keep one row per key."""
    window = F.expr(f"interval {OVERLAP_SECONDS} seconds")
    reread = rows.filter(F.col("ts") >= checkpoint - window)
    return keep_first(reread.filter(F.col("ts") > checkpoint), keys, order)
