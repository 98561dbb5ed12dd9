"""State backtest by class: the newest cases of each kind of event are replayed alone and compared field by field.

A case is an asset whose stored state differs from the base by one kind of event, with the transaction that should explain it:

* LOCK     it is locked, and not by the base's lock
* RESTART  it is locked and its last activity is not the base's
* BURN     it is burned and the base's was not
* UNLOCK   neither is burned, it is not locked, and its last movement was matched with an unlock call
* TRANSFER neither is burned or locked, its owner differs, and its last movement was matched with no call

The transaction alone is applied to the state that it requires before: the base row for a burn and a transfer, a row owned by
the sender for a lock, a locked row for an unlock. A restart call is replayed on the stored lock with the base's activity, if
that belongs to the same lock; it must come from the user of the lock, not before it, and after that activity.

Only the newest cases of each class are kept, one for each transaction. They are chosen before anything is decoded or joined:
the transactions to replay are a handful, and the log is only looked up by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.custody import LOCK, RESTART, SENT, TRANSFER, UNLOCK
from ledgerweave.operators.state import ACTIVITY_DEPTH, ACTIVITY_SOURCE, latest_state, merge_state

BURN = "BURN"
OTHER = "MOVED"  # a transfer or an unlock: only the replayed movement tells
MISSING, AMBIGUOUS = "missing event", "ambiguous event"
OWNERSHIP = ["raw_owner", "owner", "locked", "custody_wallet"]
#: Fields that an event of a class determines.
FIELDS = {
    LOCK: [*OWNERSHIP, "latest_ts", "latest_tx", "lock_user", "lock_ts", "lock_tx"],
    RESTART: ["activity_ts", "activity_tx", "activity_source", "activity_depth"],
    BURN: [*OWNERSHIP, "latest_ts", "latest_tx", "burned", "burn_ts", "burn_tx", "lock_user", "lock_ts", "activity_ts", "activity_tx"],
    TRANSFER: [*OWNERSHIP, "latest_ts", "latest_tx", "lock_user", "lock_ts", "activity_ts", "activity_tx"],
    UNLOCK: [*OWNERSHIP, "latest_ts", "latest_tx", "lock_user", "lock_ts", "activity_ts", "activity_tx"],
}


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def backtest_cases(stored: DataFrame, base: DataFrame, newest: int | None) -> DataFrame:
    """``class, asset, tx, at``: per class the ``newest`` cases by time, one for each transaction; all if None.

    The class of a moved asset stays open here, so those are ranked together.
    """
    names = ["burned", "locked", "raw_owner", "lock_tx", "activity_tx", "latest_tx"]
    both = stored.join(base.select("asset", *[F.col(c).alias(f"_b_{c}") for c in names]), "asset", "left")
    burned, was_burned = F.col("burned") == 1, F.coalesce(F.col("_b_burned") == 1, F.lit(False))
    locked, was_locked = F.col("locked") == 1, F.coalesce(F.col("_b_locked") == 1, F.lit(False))
    moved = ~burned & ~was_burned & ~locked & _differs("latest_tx", "_b_latest_tx") & (was_locked | _differs("raw_owner", "_b_raw_owner"))
    kinds = [
        (LOCK, locked & F.col("lock_tx").isNotNull() & _differs("lock_tx", "_b_lock_tx"), "lock"),
        (RESTART, locked & F.col("activity_tx").isNotNull() & _differs("activity_tx", "_b_activity_tx"), "activity"),
        (BURN, burned & ~was_burned, "burn"),
        (OTHER, moved, "latest"),
    ]
    case = F.array(*[F.when(test, F.struct(F.lit(k).alias("class"), F.col(f"{p}_tx").alias("tx"), F.col(f"{p}_ts").alias("at"))) for k, test, p in kinds])
    cases = both.select("asset", F.inline(F.array_compact(case)))
    once = cases.groupBy("class", "tx").agg(F.min(F.struct("asset", "at")).alias("_c")).select("class", "_c.asset", "tx", "_c.at")
    if newest is None:
        return once
    # Each task keeps its own newest rows of a class, and only those meet.
    order = Window.partitionBy("class").orderBy(F.desc_nulls_last("at"), F.desc("tx"), "asset")
    return once.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= newest).drop("_n")


def _compared(rows: DataFrame, label: str, fields: list[str], problem: Column) -> DataFrame:
    wrong = F.array_compact(F.array(problem, *[F.when(_differs(c, f"_r_{c}"), F.lit(c)) for c in fields]))
    found = F.when(problem.isNotNull(), F.array(problem)).otherwise(wrong)
    return rows.select(F.lit(label).alias("class"), "asset", "tx", F.array_join(found, "|").alias("mismatched"))


def backtest_by_class(stored: DataFrame, base: DataFrame, moves: DataFrame, calls: DataFrame, newest: int | None = 4) -> DataFrame:
    """``class, asset, tx, mismatched, passed`` of the newest cases of each class.

    ``moves`` are movements with their matched calls, ``calls`` all calls, both as decoded from the raw transactions.
    """
    cases = backtest_cases(stored, base, newest)
    events = moves.join(cases.select("class", "asset", "tx").withColumnRenamed("class", "_case"), ["asset", "tx"])
    alone = events.groupBy("asset", "tx", "_case").agg(F.count(F.lit(1)).alias("_n"))
    # An asset may have cases of several classes; each is replayed on a row of its own.
    key = F.concat_ws("|", "_case", F.col("asset").cast("string"), F.col("tx").cast("string"))
    keyed = events.withColumns({"_asset": F.col("asset"), "asset": key})
    # Before the event: the sender's, locked in the wallet it leaves if it is an unlock; a burn and a transfer start from the base.
    fresh = F.col("_case").isin(LOCK, OTHER) & F.col("matched").isNotNull()
    names = [c for c in base.columns if c != "asset"]
    started = keyed.filter(~fresh).select(F.col("asset").alias("_key"), F.col("_asset").alias("asset")).distinct()
    # An asset that the base lacks has nothing behind it.
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(base.schema[c].dataType).alias(c) if c in ("burned", "locked") else F.col(c)
    start = started.join(base, "asset", "left").select(F.col("_key").alias("asset"), *[zero(c) for c in names])
    blank = {c: F.lit(None) for c in names}
    sender = blank | {"burned": F.lit(0), "locked": F.when(F.col("matched") == UNLOCK, 1).otherwise(0), "raw_owner": F.col("from_owner"), "owner": F.coalesce("caller", "from_owner")}
    made = keyed.filter(fresh).select("asset", *[sender[c].cast(base.schema[c].dataType).alias(c) for c in names])
    replay = merge_state(start.unionByName(made).dropDuplicates(["asset"]), latest_state(keyed))
    kind = F.when(F.col("class") == SENT, BURN).when(F.col("matched") == LOCK, LOCK).when(F.col("matched") == UNLOCK, UNLOCK).otherwise(TRANSFER)
    seen = events.select("asset", "tx", "_case", kind.alias("_kind")).dropDuplicates(["asset", "tx", "_case"])
    played = replay.select(F.col("asset").alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in names])
    moved = (
        cases.filter(F.col("class") != RESTART)
        .withColumnRenamed("class", "_case")
        .join(alone, ["asset", "tx", "_case"], "left")
        .join(seen, ["asset", "tx", "_case"], "left")
        .withColumn("_key", key)
        .join(played, "_key", "left")
        .join(stored, "asset")
    )
    expected = F.when(F.col("_case") == OTHER, F.coalesce("_kind", F.lit(TRANSFER))).otherwise(F.col("_case"))
    problem = F.when(F.col("_n").isNull(), MISSING).when((F.col("_n") > 1) | (F.col("_kind") != F.col("_class")), AMBIGUOUS)
    moved = moved.withColumn("_class", expected).withColumn("_problem", problem)
    out = [_compared(moved.filter(F.col("_class") == label), label, FIELDS[label], F.col("_problem")) for label in (LOCK, BURN, TRANSFER, UNLOCK)]

    asked = calls.filter(F.col("action") == RESTART).select("tx", F.col("caller").alias("_caller"), F.col("ts").alias("_ts"))
    held = base.select("asset", F.col("lock_tx").alias("_b_lock_tx"), F.col("activity_ts").alias("_b_ts"), F.col("activity_tx").alias("_b_tx"))
    row = cases.filter(F.col("class") == RESTART).select("asset", "tx").join(stored, "asset").join(held, "asset", "left")
    same_lock = F.col("lock_tx").eqNullSafe(F.col("_b_lock_tx"))
    prior_ts, prior_tx = F.when(same_lock, F.col("_b_ts")), F.when(same_lock, F.col("_b_tx"))
    # The call of this user in the transaction; there is one, however many calls the transaction holds.
    own = asked.join(row.select("tx", F.col("lock_user").alias("_caller")).distinct(), ["tx", "_caller"], "left_semi").groupBy("tx", "_caller").agg(F.max("_ts").alias("_ts"))
    met = row.join(own.withColumnRenamed("_caller", "lock_user"), ["tx", "lock_user"], "left")
    counts = (F.col("_ts") >= F.col("lock_ts")) & F.coalesce(F.col("_ts") > prior_ts, F.lit(True))
    after = {
        "activity_ts": F.when(counts, F.col("_ts")).otherwise(prior_ts),
        "activity_tx": F.when(counts, F.col("tx")).otherwise(prior_tx),
        "activity_source": F.when(counts, F.lit(ACTIVITY_SOURCE)),
        "activity_depth": F.when(counts, F.lit(ACTIVITY_DEPTH)),
    }
    met = met.withColumns({f"_r_{c}": e for c, e in after.items()}).withColumn("_problem", F.when(F.col("_ts").isNull(), MISSING))
    out.append(_compared(met, RESTART, FIELDS[RESTART], F.col("_problem")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.withColumn("passed", F.col("mismatched") == "")


def backtest_report(results: DataFrame) -> DataFrame:
    """Checks passed and failed for each class."""
    return results.groupBy("class").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
