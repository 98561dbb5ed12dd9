"""Inbox queue: ingest, frozen snapshots, ledger exclusion, acknowledgement, heartbeats, checks.

Inbox rows: tx_id, received_at, seq, status, source. ``pending`` rows are still to be reduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.fingerprint import fingerprint
from ledgerweave.functions.ordered import keep_first

# Shortest usable transaction id, heartbeat limits and the stale-data limit.
MIN_ID_LENGTH = 20
LIVE_LIMIT_HOURS = 6
DAILY_LIMIT_HOURS = 30
CRITICAL_DAYS = 30
COMMITTED = "ALREADY_COMMITTED_LOCAL"


def ingest_new(arrivals: DataFrame, inbox: DataFrame, order: Sequence[str] = ("received_at", "pos")) -> DataFrame:
    """Insert or ignore: the first arrival per id, and only ids the inbox lacks."""
    usable = arrivals.filter(F.length("tx_id") > MIN_ID_LENGTH)
    return keep_first(usable, ["tx_id"], list(order)).join(inbox.select("tx_id"), "tx_id", "left_anti")


def frozen_snapshot(inbox: DataFrame, upto: Column) -> DataFrame:
    """Pending rows that had arrived by ``upto``; later arrivals stay out."""
    return inbox.filter((F.col("status") == "pending") & (F.col("received_at") <= upto))


def keyset_page(
    snapshot: DataFrame, limit: int, after: tuple[Column, Column] | None = None
) -> DataFrame:
    """Next page by (received_at, tx_id) after a cursor."""
    rows = snapshot
    if after is not None:
        at, ident = after
        later = (F.col("received_at") > at) | ((F.col("received_at") == at) & (F.col("tx_id") > ident))
        rows = rows.filter(later)
    return rows.orderBy("received_at", "tx_id").limit(limit)


def snapshot_rules(snapshot: DataFrame) -> DataFrame:
    """Blank or duplicate ids make a snapshot unusable."""
    counts = snapshot.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("tx_id").alias("distinct_ids"),
        F.count_if(F.coalesce(F.col("tx_id"), F.lit("")) == "").alias("blank_ids"),
    )
    return counts.withColumn("ok", (F.col("blank_ids") == 0) & (F.col("n") == F.col("distinct_ids")))


def exclude_ledgered(snapshot: DataFrame, ledger: DataFrame) -> DataFrame:
    """Flag what the ledger already holds: it is not reduced again but is acknowledged again."""
    done = ledger.select("tx_id", F.lit(True).alias("_done"))
    known = F.coalesce(F.col("_done"), F.lit(False))
    return (
        snapshot.join(done, "tx_id", "left")
        .withColumn("reduce", ~known)
        .withColumn("note", F.when(known, COMMITTED))
        .drop("_done")
    )


def missing_keys(discovered: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Work list of an incremental fill: discovered ids that are not cached."""
    return discovered.select(key).distinct().join(cached.select(key), key, "left_anti")


def upsert(cached: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Insert or replace: a fresh row takes the place of the cached one."""
    return cached.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def acknowledge(requested: DataFrame, inbox: DataFrame) -> DataFrame:
    """Outcome of acknowledging ids: pending ones become processed, the rest are reported."""
    asked = requested.filter(F.length("tx_id") > MIN_ID_LENGTH).select("tx_id").distinct()
    status = F.when(F.col("status") == "pending", "processed").otherwise(F.col("status"))
    outcome = (
        F.when(F.col("status").isNull(), "missing")
        .when(status == "processed", "processed")
        .otherwise("not_processed")
    )
    return asked.join(inbox.select("tx_id", "status"), "tx_id", "left").select("tx_id", outcome.alias("outcome"))


def ack_summary(outcomes: DataFrame) -> DataFrame:
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("outcome") == "processed").alias("processed"),
        F.count_if(F.col("outcome") == "missing").alias("missing"),
        F.count_if(F.col("outcome") == "not_processed").alias("not_processed"),
    )
    return counts.withColumn("ok", (F.col("requested") > 0) & (F.col("requested") == F.col("processed")))


def status_counts(inbox: DataFrame) -> DataFrame:
    return inbox.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def attempts(inbox: DataFrame, failures: DataFrame) -> DataFrame:
    """Attempt counter: failures logged while a row is pending; the last error stays."""
    tried = failures.groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.max(F.struct("failed_at", "error"))["error"].alias("last_error")
    )
    return (
        inbox.filter(F.col("status") == "pending")
        .join(tried, "tx_id", "left")
        .select("tx_id", F.coalesce("attempts", F.lit(0)).cast("bigint").alias("attempts"), "last_error")
    )


def latest_heartbeat(beats: DataFrame) -> DataFrame:
    """Latest success per known pipeline."""
    return beats.groupBy("pipeline").agg(F.max("at").alias("last_success_at"))


def freshness(checked_at: Column, live_beat: Column, daily_beat: Column, state_day: Column, floor_day: Column) -> Column:
    """``healthy``, ``warning`` for a late pipeline, ``critical`` when both data domains are old.

    A missing heartbeat is no evidence of lateness.
    """
    hours = lambda beat: (F.unix_micros(checked_at) - F.unix_micros(beat)) / F.lit(3_600_000_000.0)
    late = F.coalesce(hours(live_beat) > LIVE_LIMIT_HOURS, F.lit(False)) | F.coalesce(
        hours(daily_beat) > DAILY_LIMIT_HOURS, F.lit(False)
    )
    age = lambda day: F.datediff(checked_at, day)
    old = F.coalesce((age(state_day) > CRITICAL_DAYS) & (age(floor_day) > CRITICAL_DAYS), F.lit(False))
    return F.when(old, "critical").when(late, "warning").otherwise("healthy")


def batch_manifest(batch: DataFrame) -> DataFrame:
    """Id count and content hash of a batch as one row; blank or duplicate ids make it invalid.

    The ids themselves stay a table: the batch is its own id list.
    """
    return fingerprint(
        batch,
        ["tx_id"],
        (F.count(F.lit(1)) == F.count_distinct("tx_id")).alias("unique_ids"),
        (F.count_if(F.coalesce(F.col("tx_id"), F.lit("")) == "") == 0).alias("no_blank_ids"),
    )


def recover_batch(manifest_ids: DataFrame, stated: DataFrame) -> DataFrame:
    """Ids of a committed manifest, to be acknowledged again after a stop between commit and acknowledgement.

    ``stated`` is the one-row summary that was committed with the ids; if their count or hash differs, the query fails.
    """
    found = batch_manifest(manifest_ids)
    mark = lambda df: df.select(F.concat_ws(":", F.col("n").cast("string"), "content_hash")).scalar()
    checked = manifest_ids.withColumn("_found", mark(found)).withColumn("_stated", mark(stated))
    wrong = F.raise_error(F.lit("the manifest's ids are not those that were committed"))
    return checked.select(F.when(F.col("_found") == F.col("_stated"), F.col("tx_id")).otherwise(wrong).alias("tx_id"))
