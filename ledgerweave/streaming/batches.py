"""Arrivals are landed in an inbox table first; batches are reduced from the inbox, never from the stream.

A stream only appends: every arrival goes into the inbox, insert-or-ignore, whatever its time. A batch is what is pending
in the inbox at an instant S. Rows that arrive after S stay pending and are in the batch of a later instant.

A batch never looks through the history for what is pending. It keeps a mark, the inbox version up to which arrivals have been
looked at, and the ``open`` table of rows that had landed by then but belong to a later instant. The next batch reads the open
rows and the inbox versions above the mark. The mark counts landings, not times, so a row that arrives late, however old its
time is, lies above it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerweave.functions.ordered import keep_first
from ledgerweave.operators.inbox import COMMITTED, batch_manifest, recover_batch, upsert
from ledgerweave.plans.live_batch import decode_batch, empty_state, reduce_batch
from ledgerweave.session import settled, spool
from ledgerweave.sources.tables import ByChange, commit_version, is_committed, read_latest, read_overlapping, read_since
from ledgerweave.sources.tx_json import scan_tx
from ledgerweave.streaming.products import CHANGES, change_rows


SOURCE = "RAW_INBOX"  # where a ledger row comes from


class UnresolvedBatch(RuntimeError):
    """The batch holds rows or movements that must not be guessed; no table of the batch was committed."""


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the stream that keeps its progress in ``checkpoint``; a new checkpoint is a new stream."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def append_once(
    df: DataFrame, root: str, key: str, order: str, name: str, stream: str | None = None, batch: int | None = None
) -> None:
    """Insert-or-ignore of one micro-batch into an append-only table.

    ``order`` is a value a repeated key repeats; the table is kept in its order, so only the versions and the part of them
    that the batch overlaps are read back. A micro-batch that has been committed is skipped.
    """
    spark: SparkSession = df.sparkSession
    if stream is not None and is_committed(spark, root, stream, batch):
        return
    with spool(spark) as keep:
        fresh = one_per_key(keep(df), key, keep)
        low, high = fresh.agg(F.min(order), F.max(order)).first()
        span = None if low is None else (low, high)
        held = None if span is None else read_overlapping(spark, root, name, order, *span)
        if held is not None:
            fresh = fresh.join(found(fresh, held, key, keep), key, "left_anti")
        commit_version(spark, root, {name: (fresh, [order, key])}, stream, batch, span)


def one_per_key(df: DataFrame, key: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The least row of each key. Keys are counted first, so that only rows whose key repeats are moved."""
    repeated = keep(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    many = df.join(repeated, same, "left_semi")
    return df.join(repeated, same, "left_anti").unionByName(keep_first(many, [key], [c for c in df.columns if c != key]))


def found(df: DataFrame, held: DataFrame, key: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Keys of ``held`` that ``df`` has too: mostly few, so that wide rows need not be moved to be told apart."""
    return keep(held.select(key).join(df.select(key), key, "left_semi"))


def candidates(spark: SparkSession, inbox: str, tables: str, mark: str) -> tuple[DataFrame | None, int | None]:
    """Rows no batch has taken yet: the open ones of the last batch and what has landed above its mark; and the new mark.

    ``mark`` names the one-row table that holds it.
    """
    last = read_latest(spark, tables, mark)
    landed, upto = read_since(spark, inbox, "rows", None if last is None else last.select("mark").first()[0])
    if last is None:
        return landed, upto
    still = read_latest(spark, tables, "open")
    return still if landed is None else still.unionByName(landed), upto


def run_ledger(
    stream: DataFrame, root: str, checkpoint: str, key: str, order: str, name: str = "ledger"
) -> StreamingQuery:
    """Append everything that has arrived, micro-batch by micro-batch, then stop."""

    def land(df: DataFrame, batch: int) -> None:
        append_once(df, root, key, order, name, stream_id(df.sparkSession, checkpoint), batch)

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_snapshot(stream: DataFrame, upto: Column, root: str, checkpoint: str) -> DataFrame:
    """Land all arrivals, then freeze the batch at ``upto``: pending rows that no earlier snapshot has taken.

    Rows are ``tx_id, received_at, seq, status, ...``. Returns the rows of this snapshot.
    """
    spark = stream.sparkSession
    finish(run_ledger(stream, f"{root}/inbox", checkpoint, "tx_id", "seq", "rows"))
    tables = f"{root}/snapshots"
    rows, mark = candidates(spark, f"{root}/inbox", tables, "marks")
    if rows is None:
        return spark.createDataFrame([], stream.schema)
    rows = settled(rows.filter(F.col("status") == "pending"))
    taken = F.coalesce(F.col("received_at") <= upto, F.lit(False))
    frozen = rows.filter(taken)
    marks = spark.createDataFrame([(mark,)], "mark bigint")
    frames = {"ids": (frozen.select("tx_id"), ["tx_id"]), "open": (rows.filter(~taken), ["tx_id"]), "marks": (marks, ["mark"])}
    commit_version(spark, tables, frames)
    return frozen


def reduce_pending(
    spark: SparkSession,
    root: str,
    assets: DataFrame,
    snapshot: Column,
    activation: Column,
    encoding: str = "base58",
) -> int | None:
    """Reduce what is pending in the inbox at ``snapshot`` and commit all outputs together; None if nothing is.

    One version holds the state, cursors, new sales, new ledger rows and counters, the manifest (the ids of the batch,
    those the ledger held already among them, so that they are acknowledged again) and a checkpoint row that sums it up.
    Unresolved cases go to the ``quarantine`` table with their reasons, and nothing else is committed.
    """
    tables = f"{root}/tables"
    rows, mark = candidates(spark, f"{root}/inbox", tables, "checkpoint")
    if rows is None:
        return None
    with spool(spark) as keep:
        with spool(spark) as brief:  # what is not read by the commit is gone before it
            arrived_by = F.coalesce(F.col("received_at") <= snapshot, F.lit(False))
            decoded = brief(decode_batch(scan_tx(rows.filter(arrived_by), snapshot), encoding))
            low, high, total = decoded.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
            if not total:
                return None
            state = read_latest(spark, tables, "state")
            cursors = read_latest(spark, tables, "cursors")
            first = state is None
            state = empty_state(assets) if first else state
            if cursors is None:
                cursors = spark.createDataFrame([], "asset string, last_seq bigint, last_tx string")
            # A repeated transaction has its old sequence number, and both tables are written in that
            # order, so versions and files elsewhere in it stay unread.
            sold = read_overlapping(spark, tables, "sales", "seq", low, high)
            held = read_overlapping(spark, tables, "ledger", "seq", low, high)
            sold = spark.createDataFrame([], "tx string, asset string") if sold is None else sold
            known, fresh = spark.createDataFrame([], "tx_id string"), decoded
            if held is not None:
                known = found(decoded, held.select(F.col("tx").alias("tx_id")), "tx_id", keep)
                fresh = decoded.join(known, "tx_id", "left_anti")
            result = reduce_batch(fresh.filter(F.col("reason").isNull()), state, cursors, sold, activation, keep, brief)
            problems = keep(
                result.unresolved.select("tx", F.col("asset").cast("string").alias("asset"), "reason")
                .unionByName(
                    fresh.filter(F.col("reason").isNotNull()).select(
                        F.col("tx_id").alias("tx"), F.lit(None).cast("string").alias("asset"), "reason"
                    )
                )
                .unionByName(
                    result.conflicts.select(
                        F.lit(None).cast("string").alias("tx"),
                        F.col("asset").cast("string").alias("asset"),
                        F.lit("same sequence conflict").alias("reason"),
                    )
                )
            )
            shown = problems.limit(5).collect()
            if shown:
                commit_version(spark, f"{root}/quarantine", {"rows": (problems, ["reason", "tx", "asset"])})
                raise UnresolvedBatch(
                    f"{problems.count()} cases, all in {root}/quarantine; "
                    + "; ".join(f"{r['tx'] or r['asset']}: {r['reason']}" for r in shown)
                )
            already = known.select("tx_id", F.lit(COMMITTED).alias("note"))
            ids = keep(decoded.select("tx_id", "received_at", "seq").join(already, "tx_id", "left"))
            failed = fresh.filter(~F.col("ok")).agg(F.count(F.lit(1)).alias("n"))
            more = keep(
                failed.select(F.lit("FAILED_TX").alias("counter"), "n")
                .unionByName(ids.agg(F.count("note").alias("n")).select(F.lit(COMMITTED).alias("counter"), "n"))
                .filter("n > 0")
            )
            ledger = keep(result.ledger.filter("tx IS NOT NULL").withColumn("source", F.lit(SOURCE)))
        stamp = batch_manifest(ids).crossJoin(  # both sides are one row
            ids.agg(
                F.max("received_at").alias("last_received_at"),
                F.max("seq").alias("last_seq"),
                F.count_if(F.col("note").isNull()).alias("reduced"),
            )
        )
        changed = keep(result.state)
        changed = keep(upsert(state, changed, "asset")) if first else changed
        return commit_version(
            spark,
            tables,
            {
                "state": ByChange(changed, "asset"),
                CHANGES: (change_rows(None if first else state, changed), ["asset"]),
                "cursors": ByChange(result.cursors, "asset"),
                "sales": (result.sales, ["seq", "tx", "asset"]),
                "ledger": (ledger, ["seq", "tx"]),
                "counters": (result.counters.unionByName(more), ["counter"]),
                "manifest": (ids, ["seq", "tx_id"]),
                "open": (rows.filter(~arrived_by), []),
                "checkpoint": (stamp.withColumn("snapshot", snapshot).withColumn("mark", F.lit(mark).cast("bigint")), ["snapshot"]),
            },
            span=(low, high),
        )


def recover(spark: SparkSession, root: str) -> DataFrame | None:
    """Ids of the last committed batch, read back from its manifest and checked; None before the first commit."""
    ids = read_latest(spark, f"{root}/tables", "manifest")
    return None if ids is None else recover_batch(ids, read_latest(spark, f"{root}/tables", "checkpoint"))


def run_inbox(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    assets: DataFrame,
    snapshot: Column,
    activation: Column,
    encoding: str = "base58",
    landed: Callable[[], None] = lambda: None,
) -> int | None:
    """Land everything that has arrived, then reduce what is pending at ``snapshot``; returns the version, if any.

    ``landed`` is called in between: the inbox then holds all that the stream has taken.
    """
    finish(run_ledger(stream, f"{root}/inbox", checkpoint, "tx_id", "slot", "rows"))
    landed()
    return reduce_pending(stream.sparkSession, root, assets, snapshot, activation, encoding)
