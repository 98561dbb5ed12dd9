"""What a live batch looks up: vault deposits alone among the sales, the movements of locked assets alone for episodes."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from ledgerweave.operators import custody as C
from ledgerweave.operators import restarts as X
from ledgerweave.plans.bound_stream import SLICES, arrivals
from ledgerweave.plans.live_batch import empty_state, walk_log
from ledgerweave.session import shared_dir

T0 = dt.datetime(2024, 1, 1)
MOVES = "tx string, seq bigint, ts timestamp, asset string, class string, from_owner string, to_owner string, burn_ok boolean"
CALLS = "tx string, seq bigint, ts timestamp, ok boolean, pos int, action string, caller string, wallet string"


def move(tx, seq, asset, kind, source, target, burn_ok=False):
    return tx, seq, T0 + dt.timedelta(seconds=seq), asset, kind, source, target, burn_ok


def test_cases_a_reducer_must_not_guess(spark):
    """Deposits sold and unsold, twice, one-way, and with a call; burns; a null key; sales without a movement are given."""
    rows = [
        move("sold", 1, "A", C.TRANSFER, "u", "vault"), move("sold", 1, "A", C.TRANSFER, "u", "vault"),
        move("unsold", 2, "A", C.TRANSFER, "u", "vault"), move("unsold", 2, "A", C.TRANSFER, "u", "vault"),
        move("one", 3, "A", C.TRANSFER, None, "vault"), move("plain", 4, "A", C.TRANSFER, "u", "w"),
        move(None, 5, "A", C.TRANSFER, "u", "vault"), move("burn", 6, "A", C.SENT, "u", None, True),
        move("nodata", 7, "A", C.SENT, "u", None), move("whose", 8, "A", C.SENT, None, None, True), move("made", 9, "A", C.RECEIVED, None, "u"),
    ]
    calls = [(tx, 1, T0, True, 0, C.LOCK, "u", to) for tx, to in (("sold", "vault"), ("unsold", "vault"), ("plain", "w"), ("lost", "w"))]
    calls = spark.createDataFrame(calls, CALLS)
    matched = C.match_custody(spark.createDataFrame(rows, MOVES), calls)
    sales = spark.createDataFrame([("sold", "A"), ("sold", "A"), ("nowhere", "B")], "tx string, asset string")
    want = [
        ("burn", None), ("lost", "lock call without movement"), ("made", "received from zero"), ("nodata", "sent without burn instruction"),
        ("nowhere", "sale without movement"), ("one", "ambiguous transfer"), ("unsold", "lock call without movement"),
        ("unsold", "vault deposit without sale"), ("unsold", "vault deposit without sale"), ("whose", "ambiguous burn source"), (None, "vault deposit without sale"),
    ]
    want = sorted(((tx, reason) for tx, reason in want if reason), key=repr)
    for unmoved in (None, C.sales_by_movement(sales, matched, moved=False)):
        found = C.unresolved(matched, calls, sales, ["vault"], unmoved)
        assert sorted(((r["tx"], r["reason"]) for r in found.collect()), key=repr) == want


def test_episodes_are_sought_among_locked_assets(spark, monkeypatch):
    """A is locked by the batch, B before it; the 200 movements of other assets are not walked, and all states are right."""
    rows = [move("lock-a", 1, "A", C.TRANSFER, "u", "w"), move("off-b", 3, "B", C.TRANSFER, "w", "u")]
    rows += [move(f"m{i}", 10 + i, f"X{i % 50}", C.TRANSFER, "p", "q") for i in range(200)]
    calls = [("lock-a", 1, T0, True, 0, C.LOCK, "u", "w"), ("again", 5, T0 + dt.timedelta(seconds=5), True, 0, C.RESTART, "u", None)]
    base = empty_state(spark.createDataFrame([(a,) for a in ["A", "B", *(f"X{i}" for i in range(50))]], "asset string"))
    held = F.col("asset") == "B"
    base = base.withColumns({"locked": F.when(held, 1).otherwise(0).cast("bigint"), "lock_user": F.when(held, "u"), "lock_ts": F.when(held, F.lit(T0))})
    walked = []
    episodes = X.lock_episodes
    monkeypatch.setattr(X, "lock_episodes", lambda applied, *rest: walked.append(applied.count()) or episodes(applied, *rest))
    none = spark.createDataFrame([], "asset string, last_seq bigint, last_tx string")
    log = walk_log(spark.createDataFrame(rows, MOVES), spark.createDataFrame(calls, CALLS), base, none, F.lit(dt.datetime(2000, 1, 1)))
    state = {r["asset"]: r for r in log.state(base).collect()}
    assert walked == [2]
    assert (state["A"]["locked"], state["A"]["activity_tx"]) == (1, "again") and (state["B"]["locked"], state["B"]["activity_tx"]) == (0, None)
    assert {state[f"X{i}"]["owner"] for i in range(50)} == {"q"}


def test_arrivals_in_as_many_files_as_asked(spark):
    home = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows = spark.range(3000).select(F.col("id").alias("slot"))
    arrivals(spark, rows, "slot", f"{home}/in", files=7)
    names = [n for n in os.listdir(f"{home}/in".removeprefix("file:")) if n.endswith(".parquet")]
    assert len(names) == SLICES * 7
    assert spark.read.parquet(f"{home}/in").exceptAll(rows).count() == 0
