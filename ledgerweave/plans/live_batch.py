"""One batch end to end: scanned transactions to state, cursors, sales, ledger and unresolved cases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave import constants as K
from ledgerweave.operators import custody as C
from ledgerweave.operators import decode as D
from ledgerweave.operators import restarts as X
from ledgerweave.operators import state as T
from ledgerweave.session import settled

PROGRAMS = [K.CUSTODY_PROGRAM, K.SYSTEM_PROGRAM, *K.TOKEN_PROGRAMS, *[x.program for x in K.SALE_LAYOUTS]]


Keep = Callable[[DataFrame], DataFrame]  # holds a frame that is read many times


@dataclass
class Reduction:
    """Frames of a reduced batch. ``unresolved`` and ``conflicts`` must be empty before a commit.

    ``state`` and ``cursors`` hold the assets that the batch changed, and no others.
    """

    state: DataFrame
    cursors: DataFrame
    sales: DataFrame
    ledger: DataFrame
    unresolved: DataFrame
    conflicts: DataFrame
    counters: DataFrame


def empty_state(assets: DataFrame, tx_type: str = "string") -> DataFrame:
    """State of assets nothing has happened to."""
    kinds = dict.fromkeys(T.STATE_COLUMNS, "string")
    kinds |= {c: "timestamp" for c in ("burn_ts", "latest_ts", "lock_ts", "activity_ts")}
    kinds |= {c: tx_type for c in ("burn_tx", "latest_tx", "lock_tx", "activity_tx")}
    rest = [F.lit(None).cast(kinds[c]).alias(c) for c in T.STATE_COLUMNS if c not in ("asset", "burned", "locked")]
    zero = F.lit(0).cast("bigint")
    return assets.select("asset", zero.alias("burned"), zero.alias("locked"), *rest).select(*T.STATE_COLUMNS)


@dataclass
class Walk:
    """A log walked against a base: gated movements, those applied, restart updates of episodes and effects of calls."""

    gated: DataFrame
    applied: DataFrame
    updates: DataFrame
    effects: DataFrame

    def state(self, base: DataFrame) -> DataFrame:
        moved = T.merge_state(base, T.latest_state(self.applied))
        return X.apply_restarts(moved, self.updates, T.ACTIVITY_SOURCE, T.ACTIVITY_DEPTH)


def walk_log(
    moves: DataFrame, calls: DataFrame, base: DataFrame, cursors: DataFrame, activation: Column, keep: Keep = lambda df: df
) -> Walk:
    gated = keep(C.cursor_gate(C.match_custody(moves, calls), cursors, activation))
    applied = gated.filter(F.col("status") == C.APPLY)
    # Mostly few assets are locked, and the movements of the others open and end no episode.
    locking = F.coalesce(F.col("matched") == C.LOCK, F.lit(False))
    ever = keep(applied.filter(locking).select("asset").unionByName(base.filter("locked = 1").select("asset")).distinct())
    episodes = X.lock_episodes(applied.join(ever, "asset", "left_semi"), base)
    asked, spans = X.walk(episodes, calls.filter(F.col("action") == C.RESTART))
    odd = X.stray_updates(asked, spans)
    return Walk(gated, applied, X.restart_fanout(asked, spans, odd), X.restart_effects(asked, spans, odd))


def reduce_log(
    moves: DataFrame, calls: DataFrame, base: DataFrame, cursors: DataFrame, activation: Column
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """State after movements and calls; returns (state, cursors, gated movements, call effects)."""
    log = walk_log(moves, calls, base, cursors, activation)
    return log.state(base), T.next_cursors(cursors, log.applied), log.gated, log.effects


def decode_batch(scanned: DataFrame, encoding: str = "base58") -> DataFrame:
    """Decode scanned transactions; rows that cannot be used keep their ``reason`` and are not decoded."""
    usable = scanned.withColumn("tx", F.when(F.col("reason").isNull(), F.col("tx")))
    decoded = D.decode_tx(usable, encoding, PROGRAMS, carry=["received_at", "reason"])
    return D.calls_read_later(D.with_sales(D.with_movements(D.with_royalties(decoded)))).drop("keys", "pre", "post")


def reduce_batch(
    decoded: DataFrame,
    base: DataFrame,
    cursors: DataFrame,
    sold_before: DataFrame,
    activation: Column,
    keep: Keep = settled,
    brief: Keep | None = None,
) -> Reduction:
    """Reduce decoded transactions that the ledger does not hold yet. The frames read what ``keep`` holds.

    Only ``ledger``, ``unresolved`` and ``conflicts`` read ``decoded`` and what ``brief`` holds.
    """
    brief = brief or keep
    assets = base.select("asset")
    fine = decoded.filter("ok")
    moves = brief(D.movement_rows(fine, assets))
    calls = keep(D.custody_calls(fine))
    sales = keep(D.sale_rows(fine, assets))
    log = walk_log(moves, calls, base, cursors, activation, keep)
    gated, effects = log.gated, log.effects
    moved = log.applied.select("asset").distinct()
    restarted = log.updates.filter(F.col("end_seq") == X.FOREVER).select("asset")
    touched = keep(moved.unionByName(restarted).distinct())
    # Mostly few: only keys move to find them, and sales need not move to leave them out.
    still = keep(C.sales_by_movement(sales.select("tx", "asset"), gated, moved=False))
    reasons = C.unresolved(gated, calls, sales, [K.MARKET_VAULT], still).unionByName(
        fine.filter("undecodable").select(
            F.col("tx_id").alias("tx"), F.lit(None).cast("string").alias("asset"), F.lit("undecodable data").alias("reason")
        )
    )
    sold = sales.join(still.toDF("_tx", "_asset"), F.col("tx").eqNullSafe(F.col("_tx")) & F.col("asset").eqNullSafe(F.col("_asset")), "left_anti")
    known = keep(sold_before.select("tx", "asset").join(sold.select("tx", "asset"), ["tx", "asset"], "left_semi"))
    fresh = sold.join(known, ["tx", "asset"], "left_anti")
    again = sold.join(known, ["tx", "asset"], "left_semi").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    updates = keep(effects.groupBy("tx").agg(F.sum("assets_changed").alias("restart_updates")))  # its size is known to the join
    ledger = (
        D.ledger_rows(decoded, assets, ["received_at"], keep)
        .join(updates, "tx", "left")
        .withColumn("restart_updates", F.coalesce("restart_updates", F.lit(0)).cast("bigint"))
    )
    total = updates.agg(F.coalesce(F.sum("restart_updates"), F.lit(0)).cast("bigint")).scalar()
    return Reduction(
        state=log.state(base.join(touched, "asset", "left_semi")),
        cursors=T.next_cursors(cursors.join(moved, "asset", "left_semi"), log.applied),
        sales=fresh,
        ledger=ledger,
        unresolved=reasons,
        conflicts=C.conflicts(gated),
        counters=C.batch_counters(gated, calls, fresh, total).unionByName(
            again.select(F.lit("SALE_DUPLICATE").alias("counter"), "n")
        ),
    )
