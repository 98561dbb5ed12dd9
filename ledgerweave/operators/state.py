"""Asset state as a set-based reduction of the movement log, and account history.

Every accepted movement overwrites owner, custody and activity, so the state of an asset is its
last accepted movement; only the burn flag remembers earlier rows. Both are plain aggregates with
map-side combine, and an asset with very many movements never gathers them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.ordered import exclusive_prefix
from ledgerweave.operators.custody import LOCK, SENT, TRANSFER

# Provenance labels of activity taken from the live log.
ACTIVITY_SOURCE = "INDEPENDENT_LIVE"
ACTIVITY_DEPTH = "LIVE_POST_CUTOVER"

STATE_COLUMNS = [
    "asset",
    "burned",
    "burn_ts",
    "burn_tx",
    "raw_owner",
    "locked",
    "owner",
    "custody_wallet",
    "latest_ts",
    "latest_tx",
    "lock_user",
    "lock_ts",
    "lock_tx",
    "activity_ts",
    "activity_tx",
    "activity_source",
    "activity_depth",
]
OVERWRITTEN = [c for c in STATE_COLUMNS if c not in ("asset", "burned", "burn_ts", "burn_tx")]


def movement_effect(locked: Column) -> dict[str, Column]:
    """State columns written by one movement; ``locked`` says whether it is a matched lock."""
    burn = F.col("class") == SENT
    when_locked = lambda c: F.when(locked, c)
    return {
        "raw_owner": F.when(~burn, F.col("to_owner")),
        "locked": F.when(locked, 1).otherwise(0).cast("bigint"),
        "owner": F.when(locked, F.col("caller")).when(~burn, F.col("to_owner")),
        "custody_wallet": when_locked(F.col("wallet")),
        "latest_ts": F.col("ts"),
        "latest_tx": F.col("tx"),
        "lock_user": when_locked(F.col("caller")),
        "lock_ts": when_locked(F.col("ts")),
        "lock_tx": when_locked(F.col("tx")),
        "activity_ts": F.lit(None).cast("timestamp"),
        "activity_tx": F.when(F.lit(False), F.col("tx")),
        "activity_source": when_locked(F.lit(ACTIVITY_SOURCE)),
        "activity_depth": when_locked(F.lit(ACTIVITY_DEPTH)),
    }


def latest_state(applied: DataFrame) -> DataFrame:
    """State written by the applied movements: one row per asset they touch."""
    locked = (F.col("class") == TRANSFER) & F.coalesce(F.col("matched") == LOCK, F.lit(False))
    effects = movement_effect(locked)
    written = applied.select(
        "asset",
        F.struct("seq", "tx", *[e.alias(c) for c, e in effects.items()]).alias("_w"),
        F.when(F.col("class") == SENT, F.struct("seq", "tx", "ts")).alias("_b"),
    )
    last = written.groupBy("asset").agg(F.max("_w").alias("_w"), F.max("_b").alias("_b"))
    return last.select(
        "asset",
        F.when(F.col("_b").isNotNull(), 1).otherwise(0).cast("bigint").alias("burned"),
        F.col("_b.ts").alias("burn_ts"),
        F.col("_b.tx").alias("burn_tx"),
        *[F.col(f"_w.{c}") for c in OVERWRITTEN],
    )


def merge_state(base: DataFrame, written: DataFrame) -> DataFrame:
    """Base state with the written rows over it; a burn in the base stays."""
    new = written.select("asset", F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in STATE_COLUMNS[1:]])
    joined = base.join(new, "asset", "left")
    hit = F.coalesce(F.col("_new"), F.lit(False))
    out = {c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in OVERWRITTEN}
    fresh_burn = hit & (F.col("_n_burned") == 1)
    out["burned"] = F.when(fresh_burn, F.lit(1)).otherwise(F.col("burned")).cast("bigint")
    for c in ("burn_ts", "burn_tx"):
        out[c] = F.when(fresh_burn, F.col(f"_n_{c}")).otherwise(F.col(c))
    return joined.select("asset", *[out[c].alias(c) for c in STATE_COLUMNS[1:]])


def next_cursors(cursors: DataFrame, applied: DataFrame) -> DataFrame:
    """Cursor per asset after the batch: the last applied movement, else the old one."""
    rows = cursors.select("asset", F.struct(F.col("last_seq").alias("seq"), F.col("last_tx").alias("tx")).alias("_p"))
    fresh = applied.select("asset", F.struct("seq", "tx").alias("_p"))
    return (
        rows.unionByName(fresh)
        .groupBy("asset")
        .agg(F.max("_p").alias("_p"))
        .select("asset", F.col("_p.seq").alias("last_seq"), F.col("_p.tx").alias("last_tx"))
    )


def running_record(calls: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column) -> DataFrame:
    """Mark rows whose value exceeds that of every earlier row of the same key."""
    placed = exclusive_prefix(calls, keys, order, chunk, maxima={"_best": F.col(value)})
    best = F.col("_best")
    return placed.withColumn("record", best.isNull() | (F.col(value) > best)).drop("_best")


def account_history(base: DataFrame, moves: DataFrame) -> DataFrame:
    """Account table after a log of (asset, before, after) changes; old rows are never removed.

    Each change touches the account it leaves and the account it enters. The last touch by
    (ts, seq, tx) decides whether an account is current; a row new to the table starts at its
    first touch.
    """
    changed = moves.filter(~F.col("before").eqNullSafe(F.col("after")))
    touch = lambda col, flag: changed.filter(F.col(col).isNotNull()).select(
        "asset",
        F.col(col).alias("account"),
        F.lit(None).cast(moves.schema["ts"].dataType).alias("kept_first"),
        F.col("ts").alias("seen"),
        F.struct(F.lit(1).alias("rank"), "ts", "seq", "tx", F.lit(flag).alias("flag")).alias("_t"),
    )
    kept = base.select(
        "asset",
        "account",
        F.col("first_ts").alias("kept_first"),
        F.col("first_ts").alias("seen"),
        F.struct(
            F.lit(0).alias("rank"),
            F.col("last_ts").alias("ts"),
            F.lit(-1).cast("bigint").alias("seq"),
            F.lit(None).cast(moves.schema["tx"].dataType).alias("tx"),
            F.col("is_current").cast("int").alias("flag"),
        ).alias("_t"),
    )
    return (
        kept.unionByName(touch("before", 0))
        .unionByName(touch("after", 1))
        .groupBy("asset", "account")
        .agg(F.coalesce(F.max("kept_first"), F.min("seen")).alias("first_ts"), F.max("_t").alias("_t"))
        .select(
            "asset",
            "account",
            "first_ts",
            F.col("_t.ts").alias("last_ts"),
            F.col("_t.flag").cast("bigint").alias("is_current"),
        )
    )


def introduced_accounts(base: DataFrame, moves: DataFrame) -> DataFrame:
    """Accounts the base table lacks, with the transaction that first showed them."""
    changed = moves.filter(~F.col("before").eqNullSafe(F.col("after")))
    shown = lambda col: changed.filter(F.col(col).isNotNull()).select(
        F.col(col).alias("account"), "asset", F.struct("ts", "seq", "tx", "asset").alias("_t")
    )
    fresh = shown("before").unionByName(shown("after")).join(base.select("asset", "account"), ["asset", "account"], "left_anti")
    return (
        fresh.groupBy("account")
        .agg(F.min("_t").alias("_t"))
        .select("account", F.col("_t.asset").alias("asset"), F.col("_t.tx").alias("first_tx"), F.col("_t.ts").alias("first_ts"))
    )


def current_conflicts(history: DataFrame) -> DataFrame:
    """Assets with more than one current account; expected to be empty."""
    counts = history.groupBy("asset").agg(F.sum("is_current").alias("current"))
    return counts.filter(F.col("current") > 1)


def replay_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Do two reductions of one log agree? Whole rows are counted with multiplicity."""
    cols = sorted(a.columns)
    sides = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s")))
    off = sides.groupBy(*cols).agg(F.sum("_s").alias("_d"), F.count(F.lit(1)).alias("_n"))
    return off.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_seen"),
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias("only_a"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias("only_b"),
    ).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def state_backtest(stored: DataFrame, base: DataFrame, last_moves: DataFrame) -> DataFrame:
    """Replay the last movement of every asset that changed and compare with the stored state.

    ``last_moves`` holds the matched movement of each asset's ``latest_tx``. The class of a case
    follows from what the movement did.
    """
    before = base.select("asset", F.col("latest_tx").alias("_base_tx"))
    cases = stored.join(before, "asset", "left").filter(~F.col("latest_tx").eqNullSafe(F.col("_base_tx")))
    replay = latest_state(last_moves).select("asset", *[F.col(c).alias(f"_r_{c}") for c in COMPARED])
    kind = last_moves.select(
        "asset",
        F.when(F.col("class") == SENT, "BURN").otherwise(F.coalesce(F.col("matched"), F.lit("TRANSFER"))).alias("class"),
    )
    joined = cases.join(kind, "asset", "left").join(replay, "asset", "left")
    wrong = F.array_compact(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in COMPARED])
    )
    return joined.select(
        "asset", F.coalesce("class", F.lit("UNKNOWN")).alias("class"), F.array_join(wrong, "|").alias("mismatched")
    ).withColumn("passed", F.col("mismatched") == "")


COMPARED = ["raw_owner", "owner", "locked", "custody_wallet", "latest_tx"]
