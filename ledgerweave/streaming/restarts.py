"""Restart calls in the stream: two keyed operators in a row, assets first, then the users of their locks.

The first is the cursor gate of ``streaming.gate``. Beside the asset's state it sends on what its applied movements do to lock
episodes: the end of one, the start of the next. The second is keyed by user and holds the user's open episodes. It walks the
starts, ends and restart calls of a micro-batch in (seq, tx) order, movements of a transaction before its calls; a call counts
for each open episode that it is not before and whose last activity it is after. A user's open episodes are read and written
once for a micro-batch, and the walk keeps them in groups of equal activity, so a call costs the groups it joins, not the
assets in them.

For logs that arrive in (seq, tx) order the committed state equals the batch reduction of the whole log, however it is sliced.
A micro-batch's rows of one user are sorted in a task; their number is the trigger's to limit.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ledgerweave.operators.custody import RESTART
from ledgerweave.operators.restarts import from_ticks, ticks
from ledgerweave.operators.state import ACTIVITY_DEPTH, ACTIVITY_SOURCE
from ledgerweave.session import settled
from ledgerweave.sources.tables import ByChange, commit_version, is_committed, read_latest
from ledgerweave.streaming.gate import HELD, STATUSES, Gate
from ledgerweave.streaming.keyed import ConflictingMoves

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Kinds of rows between the operators and behind them, in the order in which a transaction's rows are walked.
STATE, END, START, CALL, ACTIVITY, EFFECT = "STATE", 0, 1, 2, "ACTIVITY", "EFFECT"


def _counts(figures: dict[str, int]) -> list[int]:
    return [figures[s] for s in STATUSES]


class AssetGate(Gate):
    """The gate, with the lock episodes that each applied movement ends and starts."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cursor, state, counts, conflict, steps = self.walk(rows)
        held = None if state is None else Row(**state)
        # State rows travel under a key of their own, so they are spread over all tasks.
        yield Row(user=f"#{key[0]}", step=None, asset=key[0], seq=cursor and cursor[0], tx=cursor and cursor[1], ts=None, state=held, counts=_counts(counts), conflict=conflict)
        blank = {"state": None, "counts": None, "conflict": None}
        for row, before in steps:
            if before is not None and before["locked"] and before["lock_user"] is not None:
                yield Row(user=before["lock_user"], step=END, asset=key[0], seq=row["seq"], tx=row["tx"], ts=None, **blank)
            if row["locked"] and row["lock_user"] is not None and row["tick"] is not None:
                yield Row(user=row["lock_user"], step=START, asset=key[0], seq=row["seq"], tx=row["tx"], ts=row["tick"], **blank)


class _Group:
    """Episodes of equal last activity."""

    def __init__(self, assets: dict, ts, tx):
        self.assets, self.ts, self.tx = assets, ts, tx


class UserEpisodes(StatefulProcessor):
    """Walks one user's starts, ends and calls over the open episodes. Times are microseconds."""

    def __init__(self, tx_type: str, asset_type: str):
        self.value = f"lock_ts bigint, ts bigint, tx {tx_type}"
        self.key = f"asset {asset_type}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", self.key, self.value)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        for e in initialState["episodes"]:
            self.open.updateValue((e["asset"],), (e["lock_ts"], e["ts"], e["tx"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        walked = []
        for row in rows:
            if row["step"] is None:
                yield Row(kind=STATE, **row.asDict(False), n=None)
            else:
                walked.append(row)
        if not walked:
            return
        held = {k[0]: tuple(v) for k, v in self.open.iterator()}
        where: dict = {}
        heap: list[tuple] = []
        serial = 0

        def push(group: _Group, floor, strict: bool) -> None:
            """``floor``: a call counts from here on, or only after it if ``strict``."""
            nonlocal serial
            serial += 1
            heapq.heappush(heap, (floor, strict, serial, group))

        def admit(asset, lock_ts, ts, tx) -> None:
            group = _Group({asset: None}, ts, tx)
            where[asset] = group
            push(group, *((ts, True) if ts is not None and ts >= lock_ts else (lock_ts, False)))

        for asset, (lock_ts, ts, tx) in held.items():
            admit(asset, lock_ts, ts, tx)
        locks = {asset: v[0] for asset, v in held.items()}
        for row in sorted(walked, key=lambda r: (r["seq"], r["tx"], r["step"])):
            if row["step"] == END:
                if (group := where.pop(row["asset"], None)) is not None:
                    del group.assets[row["asset"]]
            elif row["step"] == START:
                locks[row["asset"]] = row["ts"]
                admit(row["asset"], row["ts"], None, None)
            else:
                joined = None
                while heap and (heap[0][0] < row["ts"] or heap[0][0] == row["ts"] and not heap[0][1]):
                    group = heapq.heappop(heap)[3]
                    if joined is None or len(group.assets) > len(joined.assets):
                        joined, group = group, joined
                    if group is not None:  # the smaller joins the larger
                        joined.assets.update(group.assets)
                        for asset in group.assets:
                            where[asset] = joined
                n = 0
                if joined is not None:
                    joined.ts, joined.tx, n = row["ts"], row["tx"], len(joined.assets)
                    push(joined, row["ts"], True)
                yield self._out(EFFECT, row["user"], None, row["seq"], row["tx"], row["ts"], n)
        for asset in held:
            if asset not in where:
                self.open.removeKey((asset,))
        for asset, group in where.items():
            now = (locks[asset], group.ts, group.tx)
            if held.get(asset) != now:
                self.open.updateValue((asset,), now)
                if group.ts is not None:
                    yield self._out(ACTIVITY, key[0], asset, None, group.tx, group.ts, None)

    @staticmethod
    def _out(kind, user, asset, seq, tx, ts, n) -> Row:
        return Row(kind=kind, user=user, step=None, asset=asset, seq=seq, tx=tx, ts=ts, state=None, counts=None, conflict=None, n=n)

    def close(self) -> None:
        pass


def restart_stream(rows: DataFrame, calls: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """State rows, activities and call effects of each micro-batch.

    ``rows`` is a stream of ``gate_rows``, ``calls`` one of calls (tx, seq, ts, action, caller); ``start`` is a committed table
    of ``asset, last_seq, last_tx`` and state columns.
    """
    kind = rows.schema
    held = StructType([kind[c] for c in HELD])
    name = lambda c: kind[c].dataType.simpleString()
    state = ", ".join(f"{c}: {name(c)}" for c in HELD)
    fields = f"user string, step int, asset {name('asset')}, seq bigint, tx {name('tx')}, ts bigint, state struct<{state}>, counts array<bigint>, conflict bigint"
    first = second = None
    if start is not None:
        first = start.select("asset", "last_seq", "last_tx", *HELD).groupBy("asset")
        locked = start.filter((F.col("locked") == 1) & F.col("lock_user").isNotNull() & F.col("lock_ts").isNotNull())
        episode = F.struct("asset", ticks(start, "lock_ts").alias("lock_ts"), ticks(start, "activity_ts").alias("ts"), F.col("activity_tx").alias("tx"))
        second = locked.groupBy(F.col("lock_user").alias("user")).agg(F.collect_list(episode).alias("episodes")).groupBy("user")
    rows = rows.withColumn("tick", ticks(rows, "lock_ts"))
    assets = rows.groupBy("asset").transformWithState(AssetGate(held, name("tx")), fields, "Append", "None", initialState=first)
    asked = calls.filter(F.col("action") == RESTART).select(F.col("caller").alias("user"), F.lit(CALL).alias("step"), "seq", "tx", ticks(calls, "ts").alias("ts"))
    both = assets.unionByName(asked, allowMissingColumns=True)
    users = UserEpisodes(name("tx"), name("asset"))
    out = both.groupBy("user").transformWithState(users, f"kind string, {fields}, n bigint", "Append", "None", initialState=second)
    return out.withColumn("ts", from_ticks(F.col("ts"), name("lock_ts")))


def commit_restarts(df: DataFrame, root: str, stream: str, batch: int, start: DataFrame | None = None) -> None:
    """Commit a micro-batch: changed state rows by asset, effects of calls, status counts. ``start`` opens the state table."""
    spark = df.sparkSession
    if is_committed(spark, root, stream, batch):
        return
    df = settled(df)
    shown = df.filter("conflict IS NOT NULL").select("asset", "conflict").orderBy("asset").limit(5).collect()
    if shown:
        raise ConflictingMoves(", ".join(f"{r['asset']} at {r['conflict']}" for r in shown))
    columns = ["asset", "last_seq", "last_tx", *HELD]
    moved = df.filter("kind = 'STATE' AND state IS NOT NULL").select("asset", F.col("seq").alias("last_seq"), F.col("tx").alias("last_tx"), "state.*")
    told = df.filter("kind = 'ACTIVITY'").select("asset", F.col("ts").alias("_ts"), F.col("tx").alias("_tx"))
    before = read_latest(spark, root, "state")
    before = start if before is None else before
    if before is None:
        before = moved.limit(0)
    before = before.select(*columns)
    # Assets with a new activity whose state row did not move keep the one that is committed.
    still = before.join(told, "asset", "left_semi").join(moved, "asset", "left_anti")
    rows = moved.unionByName(still).join(told, "asset", "left")
    hit = F.col("_ts").isNotNull()
    fresh = {"activity_ts": F.col("_ts"), "activity_tx": F.col("_tx"), "activity_source": F.lit(ACTIVITY_SOURCE), "activity_depth": F.lit(ACTIVITY_DEPTH)}
    changed = settled(rows.withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in fresh.items()}).select(*columns))
    if read_latest(spark, root, "state") is None:
        changed = before.join(changed, "asset", "left_anti").unionByName(changed)
    effects = df.filter("kind = 'EFFECT'").select("user", "seq", "tx", "ts", F.col("n").alias("assets_changed"))
    place = F.posexplode("counts").alias("_i", "n")
    counts = df.filter("counts IS NOT NULL").select(place).groupBy("_i").agg(F.sum("n").alias("n")).filter("n > 0")
    statuses = counts.select(F.lit(batch).cast("bigint").alias("batch"), F.array(*[F.lit(s) for s in STATUSES])[F.col("_i")].alias("status"), "n")
    commit_version(spark, root, {"state": ByChange(changed, "asset"), "effects": (effects, ["seq", "tx"]), "statuses": (statuses, ["status"])}, stream, batch)
