"""Movements and restart calls through two chained keyed operators against the batch reduction of the whole log."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators.custody import match_custody
from ledgerweave.plans.live_batch import empty_state, reduce_log
from ledgerweave.session import shared_dir
from ledgerweave.sources.tables import read_appended, read_latest
from ledgerweave.streaming.batches import finish, stream_id
from ledgerweave.streaming.gate import HELD, PROVIDER, gate_rows
from ledgerweave.streaming.restarts import commit_restarts, restart_stream
from tests.test_restarts_fold import CALLS, MOVES, make_log

PAST = "2000-01-01"


def past():
    return F.lit(PAST).cast("timestamp")


def run(spark, home, slices, start=None):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    checkpoint = f"{home}/checkpoint"
    for i, (moves, calls) in enumerate(slices):
        matched = match_custody(own.createDataFrame(moves, MOVES), own.createDataFrame(calls, CALLS))
        matched.coalesce(1).write.parquet(f"{home}/moves/{i}-{uuid.uuid4().hex}")
        own.createDataFrame(calls, CALLS).coalesce(1).write.parquet(f"{home}/calls/{i}-{uuid.uuid4().hex}")
        source = lambda name, schema: own.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{home}/{name}")
        stream = restart_stream(gate_rows(source("moves", matched.schema), past()), source("calls", CALLS), start)
        land = lambda df, batch: commit_restarts(df, f"{home}/tables", stream_id(df.sparkSession, checkpoint), batch, start)
        finish(stream.writeStream.foreachBatch(land).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


@pytest.mark.parametrize(("seed", "disorder", "cuts"), [(1, False, (20, 40)), (2, True, (7, 8, 30)), (3, "busy", (31,))])
def test_equals_the_batch_reduction(spark, seed, disorder, cuts):
    moves, calls = make_log(random.Random(seed), disorder)
    edges = [0, *cuts, 1000]
    slices = [([m for m in moves if a <= m[1] < b], [c for c in calls if a <= c[1] < b]) for a, b in zip(edges, edges[1:], strict=False)]
    home = f"{shared_dir(spark)}/restarts-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], "asset string, last_seq bigint, last_tx string")
    base = empty_state(spark.createDataFrame([(a,) for a in "abcd"], "asset string"))
    start, first = None, slices
    if seed == 2:  # the first slice was reduced by a batch; the stream starts from its tables
        state, cursors, *_ = reduce_log(spark.createDataFrame(slices[0][0], MOVES), spark.createDataFrame(slices[0][1], CALLS), base, none, past())
        state.join(cursors, "asset", "left").write.parquet(f"{home}/start")
        start, first = spark.read.parquet(f"{home}/start"), slices[1:]
    run(spark, home, first, start)
    after, cursors, _, effects = reduce_log(spark.createDataFrame(moves, MOVES), spark.createDataFrame(calls, CALLS), base, none, past())
    want = {r["asset"]: r.asDict() for r in after.join(cursors, "asset", "left").collect()}
    got = {r["asset"]: r.asDict() for r in read_latest(spark, f"{home}/tables", "state").collect()}
    for asset, row in want.items():
        if row["last_seq"] is not None:
            assert {c: got[asset][c] for c in (*HELD, "last_seq", "last_tx")} == {c: row[c] for c in (*HELD, "last_seq", "last_tx")}, asset
    changed = {r["tx"]: r["assets_changed"] for r in effects.collect()}
    seen = {r["tx"]: r["assets_changed"] for r in read_appended(spark, f"{home}/tables", "effects").collect()}
    assert seen == {tx: n for tx, n in changed.items() if tx in seen} and len(seen) >= len(changed) - (len(slices[0][1]) if start is not None else 0)
    assert any(n for n in changed.values())
