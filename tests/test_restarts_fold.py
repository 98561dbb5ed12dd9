"""The set-based reduction against an event-by-event fold on random logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import restarts as X
from ledgerweave.plans.live_batch import empty_state, reduce_log

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MOVES = "tx string, seq bigint, ts timestamp, asset string, class string, from_owner string, to_owner string, burn_ok boolean"
CALLS = "tx string, seq bigint, ts timestamp, pos int, action string, caller string, wallet string"


def make_log(rng, disorder):
    moves, calls = [], []
    now = 0
    for seq in range(1, 61):
        now += rng.choice([0, 0, 1, 5])
        ts = T0 + dt.timedelta(minutes=now)
        if disorder and rng.random() < (0.8 if disorder == "busy" else 0.15):
            ts -= dt.timedelta(minutes=rng.randint(1, 30))
        tx, user = f"t{seq:03d}", "u" if disorder == "busy" else rng.choice("uv")
        kind = rng.choice(["lock", "lock", "unlock", "move", "burn", "restart", "restart", "restart"])
        asset = rng.choice("abcd")
        if kind == "lock":
            moves.append((tx, seq, ts, asset, "TRANSFER", user, "w" + user, True))
            calls.append((tx, seq, ts, 0, "LOCK", user, "w" + user))
        elif kind == "unlock":
            moves.append((tx, seq, ts, asset, "TRANSFER", "w" + user, user, True))
            calls.append((tx, seq, ts, 0, "UNLOCK", user, "w" + user))
        elif kind == "move":
            moves.append((tx, seq, ts, asset, "TRANSFER", user, rng.choice("xyz"), True))
        elif kind == "burn" and rng.random() < 0.4:
            moves.append((tx, seq, ts, asset, "BURN_OR_SEND_TO_ZERO", user, None, True))
        if kind == "restart" or rng.random() < 0.1:
            calls.append((tx, seq, ts, 1, "RESTART", user, None))
    return moves, calls


def fold(moves, calls, base):
    """State and number of changed assets per call, one event after another."""
    state = {a: dict(s) for a, s in base.items()}
    changed = {}
    events = [(m[1], m[0], 0, m) for m in moves] + [(c[1], c[0], 1, c) for c in calls if c[4] == "RESTART"]
    by_tx = {}
    for c in calls:
        by_tx.setdefault(c[0], []).append(c)
    for _, tx, phase, row in sorted(events, key=lambda e: e[:3]):
        if phase == 0:
            _, _, ts, asset, cls, source, target, _ = row
            s = state[asset]
            s.update(lock_user=None, lock_ts=None, activity_ts=None, activity_tx=None, locked=0, latest_tx=tx)
            s["raw_owner"] = s["owner"] = target
            if cls != "TRANSFER":
                s["burned"] = 1
                continue
            for c in by_tx.get(tx, []):
                if c[4] == "LOCK" and (source, target) == (c[5], c[6]):
                    s.update(locked=1, owner=c[5], lock_user=c[5], lock_ts=ts)
        else:
            n = 0
            for s in state.values():
                if not s["locked"] or s["lock_user"] != row[5] or s["lock_ts"] is None or row[2] < s["lock_ts"]:
                    continue
                if s["activity_ts"] is not None and row[2] <= s["activity_ts"]:
                    continue
                s["activity_ts"], s["activity_tx"] = row[2], tx
                n += 1
            changed[tx] = n
    return state, changed


FIELDS = ["burned", "raw_owner", "owner", "locked", "latest_tx", "lock_user", "activity_ts", "activity_tx"]


@pytest.mark.parametrize("seed,disorder,chunk", [(1, False, 7), (2, True, 7), (3, True, 1 << 18), (4, False, 3), (5, True, 2), (6, "busy", 5)])
def test_reduction_equals_fold(spark, monkeypatch, seed, disorder, chunk):
    rng = random.Random(seed)
    # Twelve independent logs share one job: every name carries its log number.
    all_moves, all_calls, want_state, want_calls, locked = [], [], {}, {}, []
    for n in range(12):
        moves, calls = make_log(rng, disorder)
        tag = lambda v, n=n: None if v is None else f"{v}{n}"
        moves = [(f"{m[0]}-{n}", m[1], m[2], tag(m[3]), m[4], tag(m[5]), tag(m[6]), m[7]) for m in moves]
        calls = [(f"{c[0]}-{n}", c[1], c[2], c[3], c[4], tag(c[5]), tag(c[6])) for c in calls]
        blank = dict.fromkeys(["raw_owner", "owner", "latest_tx", "lock_user", "lock_ts", "activity_ts", "activity_tx"])
        base = {tag(a): {**blank, "burned": 0, "locked": 0} for a in "abcd"}
        start = {"lock_user": tag("u"), "lock_ts": T0 - dt.timedelta(days=1), "locked": 1}
        base[tag("a")].update(start, activity_ts=T0 + dt.timedelta(minutes=10), activity_tx="old")
        base[tag("b")].update(start)
        locked += [(tag("a"), tag("u"), start["lock_ts"], T0 + dt.timedelta(minutes=10), "old")]
        locked += [(tag("b"), tag("u"), start["lock_ts"], None, None)]
        state, changed = fold(moves, calls, base)
        want_state |= state
        want_calls |= changed
        all_moves += moves
        all_calls += calls
    for name in ("lock_episodes", "walk", "stray_updates", "restart_effects"):
        real = getattr(X, name)
        more = {"calls": 2} if name == "stray_updates" else {}
        monkeypatch.setattr(X, name, lambda *a, real=real, more=more: real(*a, chunk=chunk, **more))
    assets = spark.createDataFrame([(a,) for a in want_state], "asset string")
    held = spark.createDataFrame(locked, "asset string, u string, l timestamp, a timestamp, x string")
    hit = F.col("u").isNotNull()
    base = empty_state(assets).join(held, "asset", "left")
    base = base.withColumns(
        {
            "locked": F.when(hit, 1).otherwise(0).cast("bigint"),
            "lock_user": F.col("u"),
            "lock_ts": F.col("l"),
            "activity_ts": F.col("a"),
            "activity_tx": F.col("x"),
        }
    ).drop("u", "l", "a", "x")
    cursors = spark.createDataFrame([], "asset string, last_seq bigint, last_tx string")
    state, _, _, effects = reduce_log(
        spark.createDataFrame(all_moves, MOVES),
        spark.createDataFrame(all_calls, CALLS),
        base,
        cursors,
        F.lit("2000-01-01").cast("timestamp"),
    )
    as_utc = lambda v: v.replace(tzinfo=dt.timezone.utc) if isinstance(v, dt.datetime) and v.tzinfo is None else v
    spark_zone = [r["z"] for r in spark.range(1).selectExpr("current_timezone() AS z").collect()]
    assert spark_zone == ["UTC"]
    got = {r["asset"]: {f: as_utc(r[f]) for f in FIELDS} for r in state.collect()}
    for asset, s in want_state.items():
        assert got[asset] == {f: s[f] for f in FIELDS}, asset
    assert {r["tx"]: r["assets_changed"] for r in effects.collect()} == want_calls
