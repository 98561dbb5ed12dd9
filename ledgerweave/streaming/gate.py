"""The cursor gate as a keyed stream: one cursor and one state row for each asset, held by the state store.

A micro-batch's movements of an asset are walked in (seq, tx) order against its cursor, which starts from the committed
cursor and state tables. Each gets a status: APPLY moves the cursor and overwrites the state, COVERED lies before the
activation instant of an asset without a cursor, DUPLICATE is the movement the cursor names, STALE lies before it. Another
transaction at the cursor's sequence number is a conflict, at whatever number it happens in the walk; it stops the stream
before anything of the micro-batch is committed, and the next start meets the same rows with the state of before.

For movements that arrive in (seq, tx) order this equals ``cursor_gate`` and ``latest_state`` over all of them at once, however
they are sliced; for others it equals those two applied to slice after slice. Restart calls are keyed by user and are not
part of it. The rows of one asset in one micro-batch are sorted in a task, so their number is the trigger's to limit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ledgerweave.operators.custody import APPLY, COVERED, DUPLICATE, LOCK, SENT, STALE, TRANSFER
from ledgerweave.operators.state import STATE_COLUMNS, movement_effect
from ledgerweave.session import settled
from ledgerweave.sources.tables import commit_version, is_committed
from ledgerweave.streaming.keyed import ConflictingMoves

# The processor goes to the tasks by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUSES = [APPLY, COVERED, DUPLICATE, STALE]
HELD = [c for c in STATE_COLUMNS if c != "asset"]
BURN = ["burned", "burn_ts", "burn_tx"]


def gate_rows(matched: DataFrame, activation: Column) -> DataFrame:
    """Movements as the gate reads them: asset, seq, tx, ``late``, and the state row that each of them would write."""
    locked = (F.col("class") == TRANSFER) & F.coalesce(F.col("matched") == LOCK, F.lit(False))
    burn = F.col("class") == SENT
    effects = movement_effect(locked) | {
        "burned": F.when(burn, 1).otherwise(0).cast("bigint"),
        "burn_ts": F.when(burn, F.col("ts")),
        "burn_tx": F.when(burn, F.col("tx")),
    }
    return matched.select("asset", "seq", "tx", (F.col("ts") <= activation).alias("late"), *[effects[c].alias(c) for c in HELD])


def _count(status: str) -> str:
    """Column that counts a status."""
    return f"n_{status.lower()}"


class Gate(StatefulProcessor):
    """Walks one asset's rows. ``held`` is the schema of a state row, ``names`` its columns in order."""

    def __init__(self, held: StructType, tx_type: str):
        self.held = held
        self.names = held.names
        self.cursor_schema = f"seq bigint, tx {tx_type}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", self.cursor_schema)
        self.state = handle.getValueState("state", self.held)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if initialState["last_seq"] is not None:
            self.cursor.update((initialState["last_seq"], initialState["last_tx"]))
        self.state.update(tuple(initialState[n] for n in self.names))

    def walk(self, rows: Iterator[Row]) -> tuple[tuple | None, dict | None, dict[str, int], int | None, list[tuple[Row, dict | None]]]:
        """Cursor and state if they moved, counts, the number of a conflict, and the applied rows with the state before each."""
        cursor = self.cursor.get() if self.cursor.exists() else None
        start = cursor
        state = dict(zip(self.names, self.state.get(), strict=True)) if self.state.exists() else None
        counts = dict.fromkeys(STATUSES, 0)
        steps = []
        for row in sorted(rows, key=lambda r: (r["seq"], r["tx"])):
            if cursor is None:
                status = COVERED if row["late"] else APPLY
            elif row["seq"] != cursor[0]:
                status = STALE if row["seq"] < cursor[0] else APPLY
            elif row["tx"] == cursor[1]:
                status = DUPLICATE
            else:
                return None, None, counts, row["seq"], []
            counts[status] += 1
            if status == APPLY:
                steps.append((row, state))
                cursor = (row["seq"], row["tx"])
                old, state = state, {n: row[n] for n in self.names}
                if old is not None and not state["burned"]:
                    state |= {n: old[n] for n in BURN}
        if cursor == start:
            return None, None, counts, None, []
        self.cursor.update(cursor)
        self.state.update(tuple(state[n] for n in self.names))
        return cursor, state, counts, None, steps

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cursor, state, counts, conflict, _ = self.walk(rows)
        last_seq, last_tx = cursor or (None, None)
        figures = {_count(s): n for s, n in counts.items()}
        yield Row(asset=key[0], last_seq=last_seq, last_tx=last_tx, **(state or dict.fromkeys(self.names)), **figures, conflict=conflict)

    def close(self) -> None:
        pass


def gated_stream(rows: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """One row for each asset that a micro-batch touches: cursor and state if they moved, a count for each status, conflict.

    ``rows`` is a stream of ``gate_rows``. ``start`` holds the committed ``asset, last_seq, last_tx`` and state columns.
    """
    kind = rows.schema
    held = StructType([kind[c] for c in HELD])
    tx_type = kind["tx"].dataType.simpleString()
    fields = [f"asset {kind['asset'].dataType.simpleString()}", "last_seq bigint", f"last_tx {tx_type}"]
    fields += [f"{c} {kind[c].dataType.simpleString()}" for c in HELD]
    fields += [f"{_count(s)} bigint" for s in STATUSES] + ["conflict bigint"]
    begin = None if start is None else start.select("asset", "last_seq", "last_tx", *HELD).groupBy("asset")
    return rows.groupBy("asset").transformWithState(Gate(held, tx_type), ", ".join(fields), "Update", "None", initialState=begin)


def commit_gated(df: DataFrame, root: str, stream: str, batch: int) -> None:
    """Commit one micro-batch of ``gated_stream``: changed cursors and states, and its status counts; refuse conflicts."""
    spark = df.sparkSession
    if is_committed(spark, root, stream, batch):
        return
    df = settled(df)
    clash = df.filter("conflict IS NOT NULL")
    shown = clash.select("asset", "conflict").orderBy("asset").limit(5).collect()
    if shown:
        raise ConflictingMoves(", ".join(f"{r['asset']} at {r['conflict']}" for r in shown))
    moved = df.filter("last_seq IS NOT NULL")
    sums = df.agg(*[F.sum(_count(s)).alias(s) for s in STATUSES]).unpivot([], STATUSES, "status", "n")
    totals = sums.filter("n > 0").select(F.lit(batch).cast("bigint").alias("batch"), "status", "n")
    frames = {"updates": (moved.select("asset", "last_seq", "last_tx", *HELD), ["asset"]), "statuses": (totals, ["status"])}
    commit_version(spark, root, frames, stream, batch)
