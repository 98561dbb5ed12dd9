"""Snapshot comparison, evidence fallback, gap audits and ledger backtests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP_KEYS = ["asset", "account", "chain_owner", "state_owner"]


def snapshot_diff(state: DataFrame, inventory: DataFrame) -> DataFrame:
    """Classes of difference per asset; one asset may fall into several."""
    left = state.select("asset", F.col("burned").alias("was"), F.col("owner").alias("old"), F.lit(1).alias("_l"))
    right = inventory.select("asset", F.col("burned").alias("now"), F.col("owner").alias("new"), F.lit(1).alias("_r"))
    both = left.join(right, "asset", "full_outer")
    known = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    was, now = F.col("was") == 1, F.col("now") == 1
    owner = F.when(~now, F.col("new"))
    tests = {
        "new_burn": known & ~was & now,
        "burn_regression": known & was & ~now,
        "owner_unresolved": known & ~now & owner.isNull(),
        "owner_change": known & ~was & ~now & ~F.col("old").eqNullSafe(owner),
        "not_in_inventory": F.col("_r").isNull(),
        "not_in_state": F.col("_l").isNull(),
    }
    labels = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return both.select("asset", F.col("old").alias("old_owner"), owner.alias("new_owner"), F.explode(labels).alias("class"))


def evidence_priority(keys: DataFrame, holdings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Holding row first, else a complete snapshot row, else no evidence."""
    held = holdings.select(
        "asset",
        F.struct(
            F.lit(0).cast("bigint").alias("supply_zero"), "owner", "account", F.lit("holdings").alias("source")
        ).alias("_h"),
    )
    seen = snapshots.filter(F.col("complete") == 1).select(
        "asset", F.struct("supply_zero", "owner", "account", F.lit("snapshot").alias("source")).alias("_s")
    )
    return (
        keys.join(held, "asset", "left")
        .join(seen, "asset", "left")
        .withColumn("_e", F.coalesce("_h", "_s"))
        .select(
            *keys.columns,
            F.col("_e.supply_zero"),
            F.col("_e.owner").alias("chain_owner"),
            F.col("_e.account"),
            F.coalesce(F.col("_e.source"), F.lit("none")).alias("source"),
        )
    )


def reconcile_state(states: DataFrame, evidence: DataFrame) -> DataFrame:
    """State against evidence: missing burn, false burn, owner gap, or agreement."""
    joined = states.select("asset", "burned", F.col("owner").alias("state_owner")).join(evidence, "asset")
    zero, burned = F.col("supply_zero") == 1, F.col("burned") == 1
    status = (
        F.when(F.col("source") == "none", "no_evidence")
        .when(zero & ~burned, "missing_burn")
        .when(zero, "agree")
        .when(burned, "false_burn")
        .when(F.col("chain_owner").isNull(), "owner_missing")
        .when(F.col("chain_owner") != F.coalesce(F.col("state_owner").cast("string"), F.lit("")), "owner_gap")
        .otherwise("agree")
    )
    return joined.select("asset", "account", "chain_owner", "state_owner", status.alias("status"))


def pending_gaps(gaps: DataFrame, audits: DataFrame) -> DataFrame:
    """Gaps without a complete audit of exactly this account and these owners."""
    return gaps.join(audits.filter(F.col("complete") == 1).select(*GAP_KEYS), GAP_KEYS, "left_anti")


def gap_budget(pending: DataFrame, cap: int) -> DataFrame:
    """Expectation on the number of gaps to audit; nothing is dropped."""
    return pending.agg(F.count(F.lit(1)).alias("pending")).withColumn("within_cap", F.col("pending") <= cap)


def excuse_gaps(gaps: DataFrame, audits: DataFrame) -> DataFrame:
    """A gap is excused only by a complete audit on all fields with no later activity."""
    clean = audits.filter((F.col("complete") == 1) & (F.col("later") == 0)).select(*GAP_KEYS).distinct()
    flagged = gaps.join(clean.withColumn("_ok", F.lit(True)), GAP_KEYS, "left")
    return flagged.withColumn("excused", F.coalesce(F.col("_ok"), F.lit(False))).drop("_ok")


def secondary_audit(states: DataFrame, other: DataFrame) -> DataFrame:
    """Agreement with a source that is reported on but never used to change state."""
    b = other.select("asset", F.col("burned").alias("o_burned"), F.col("owner").alias("o_owner"))
    joined = states.select("asset", "burned", "owner").join(b, "asset")
    burned, flag = F.col("burned") == 1, F.coalesce(F.col("o_burned") == 1, F.lit(False))
    missing = ~burned & F.col("o_owner").isNull()
    same = F.coalesce(F.col("o_owner") == F.col("owner"), F.lit(False))
    return joined.agg(
        F.count_if(~burned & same).alias("owner_match"),
        F.count_if(~burned & ~missing & ~same).alias("owner_diff"),
        F.count_if(missing).alias("owner_missing"),
        F.count_if(burned & flag).alias("burn_match"),
        F.count_if(burned & ~flag).alias("burn_regression"),
        F.count_if(~burned & flag).alias("burn_only_there"),
        F.count_if(~burned & (flag | missing | ~same)).alias("gap_targets"),
    )


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.lit(tolerance)


def backtest_compare(
    expected: DataFrame,
    decoded: DataFrame,
    keys: Sequence[str],
    exact: Sequence[str],
    close: Sequence[str],
    price: str,
    tolerance: float = 1e-9,
    legacy: Column | None = None,
    legacy_tolerance: float = 1e-6,
) -> DataFrame:
    """Compare decoded rows with a ledger field by field.

    Where ``legacy`` holds, a row that differs only in ``price`` and by no more than
    ``legacy_tolerance`` still passes.
    """
    extra = [] if legacy is None else [legacy.alias("_legacy")]
    e = expected.select(*keys, *[F.col(c).alias(f"_e_{c}") for c in [*exact, *close]], F.lit(1).alias("_e"), *extra)
    d = decoded.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in [*exact, *close]], F.lit(1).alias("_d"))
    tests = {c: F.col(f"_e_{c}").eqNullSafe(F.col(f"_d_{c}")) for c in exact}
    tests |= {c: near(F.col(f"_e_{c}"), F.col(f"_d_{c}"), tolerance) for c in close}
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in tests.items()]))
    only_price = (F.col("_bad") == F.array(F.lit(price))) & near(
        F.col(f"_e_{price}"), F.col(f"_d_{price}"), legacy_tolerance
    )
    lenient = F.coalesce(F.col("_legacy") & only_price, F.lit(False)) if extra else F.lit(False)
    verdict = (
        F.when(F.col("_d").isNull(), "not_decoded")
        .when(F.col("_e").isNull(), "not_expected")
        .when(F.size("_bad") == 0, "pass")
        .when(lenient, "legacy_pass")
        .otherwise("fail")
    )
    return (
        e.join(d, list(keys), "full_outer")
        .withColumn("_bad", bad)
        .select(
            *keys,
            verdict.alias("verdict"),
            F.when(F.col("_e").isNotNull() & F.col("_d").isNotNull(), F.array_join("_bad", "|"))
            .otherwise("")
            .alias("mismatched"),
        )
    )
