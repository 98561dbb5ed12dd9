"""Raw transactions through the streaming micro-batches to committed tables."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerweave import constants as K
from ledgerweave.operators import decode as D
from ledgerweave.session import shared_dir
from ledgerweave.operators.custody import cursor_gate
from ledgerweave.operators.inbox import batch_manifest, recover_batch
from ledgerweave.sources.tables import latest_version, read_appended, read_latest
from ledgerweave.sources.tx_json import payload_rows, scan_tx
from ledgerweave.streaming.batches import UnresolvedBatch, finish, reduce_pending, run_inbox, run_ledger
from ledgerweave.streaming.keyed import ConflictingMoves, agreed, keyed_state
from tests import txkit as X

T = 1_700_000_000
INBOX = "tx_id string, received_at timestamp, slot bigint, block_time bigint, payload string"
FIRST = [
    X.tx("lock-a", 10, T, "u", [X.custody(K.LOCK_PREFIX, "u", "w")], **X.moved("A", "u", "w")),
    X.tx("restart-u", 11, T + 60, "u", [X.restart("u"), X.restart("u")]),
    X.tx(
        "sale-b", 12, T + 70, "b",
        [X.single_sale("B", "b", "s", 70_000_000), X.pay("b", K.ROYALTY_FIRST, 900), X.pay("b", K.ROYALTY_SECOND, 100)],
        **X.moved("B", "s", "b"),
    ),
    X.tx("burn-d", 14, T + 90, "s", [X.burn("D", "s")], pre=[("acc-D-s", "D", "s", 1)]),
    X.tx("failed", 15, T + 95, "s", [X.burn("A", "w")], pre=[("acc-A-w", "A", "w", 1)], err={"InstructionError": [0, "Custom"]}),
]
BUY_C, EVENT_C = X.paired_sale(X.TM, "C", "b", "s", 123_000_000)
BUY_E, EVENT_E = X.paired_sale(X.AMM, "E", "b", "s", 50_000_000)
SECOND = [
    X.tx("sale-c", 20, T + 200, "b", [BUY_C], inner={0: [EVENT_C]}, shape="object", **X.moved("C", "s", "b")),
    X.tx("sale-e", 21, T + 210, "b", [X.pay("b", K.ROYALTY_FIRST, 27), BUY_E], inner={1: [EVENT_E]}, **X.moved("E", "s", "b")),
    X.tx("late-b", 5, T + 220, "s", [X.pay("s", "b", 1)], **X.moved("B", "b", "q")),
    X.tx("restart-u2", 22, T + 230, "u", [X.restart("u")]),
    X.tx("unlock-a", 23, T + 240, "u", [X.custody(K.UNLOCK_PREFIX, "u", "w")], **X.moved("A", "w", "u")),
    FIRST[0],
]
BROKEN = [X.tx("vanish", 30, T + 300, "s", [X.pay("s", "b", 1)], pre=[("acc-C-b", "C", "b", 1)])]


def frame(spark, rows):
    stamped = [(i, dt.datetime.fromtimestamp(r, dt.timezone.utc), s, b, p) for i, r, s, b, p in rows]
    return spark.createDataFrame(stamped, INBOX)


@pytest.fixture(scope="module")
def home(spark):
    return f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"


def run(spark, home, rows, upto="2100-01-01"):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{home}/in")
    assets = spark.createDataFrame([(a,) for a in "ABCDE"], "asset string")
    stream = spark.readStream.schema(INBOX).parquet(f"{home}/in")
    past = F.lit("2000-01-01").cast("timestamp")
    return run_inbox(stream, home, f"{home}/checkpoint", assets, F.lit(upto).cast("timestamp"), past)


def state(spark, home):
    return {r["asset"]: r.asDict() for r in read_latest(spark, f"{home}/tables", "state").collect()}


def test_batches(spark, home):
    tables = f"{home}/tables"
    run(spark, home, FIRST)
    s = state(spark, home)
    assert (s["A"]["locked"], s["A"]["owner"], s["A"]["raw_owner"], s["A"]["custody_wallet"]) == (1, "u", "w", "w")
    assert s["A"]["activity_tx"] == "restart-u"
    assert (s["B"]["owner"], s["B"]["latest_tx"]) == ("b", "sale-b")
    assert (s["D"]["burned"], s["D"]["owner"], s["D"]["burn_tx"]) == (1, None, "burn-d")
    assert s["C"]["latest_tx"] is None
    ledger = {r["tx"]: r.asDict() for r in read_appended(spark, tables, "ledger").collect()}
    assert ledger["lock-a"]["movements"] == "A:TRANSFER" and ledger["lock-a"]["calls"] == "LOCK"
    assert (ledger["restart-u"]["calls"], ledger["restart-u"]["restart_updates"]) == ("RESTART", 1)
    assert ledger["sale-b"]["sales"] == "B:Magic Eden V2"
    assert (ledger["failed"]["tx_success"], ledger["failed"]["movements"]) == (0, "")

    run(spark, home, SECOND)
    s = state(spark, home)
    assert (s["A"]["locked"], s["A"]["owner"], s["A"]["activity_tx"]) == (0, "u", None)
    assert s["B"]["owner"] == "b", "a late movement must not move the state back"
    sales = {r["asset"]: r.asDict() for r in read_appended(spark, tables, "sales").collect()}
    assert {a: int(r["price"]) for a, r in sales.items()} == {"B": 70_000_000, "C": 123_000_000, "E": 50_000_000}
    assert (int(sales["B"]["royalty"]), int(sales["B"]["royalty_second"])) == (900, 100)
    assert (int(sales["E"]["royalty"]), sales["E"]["detail"], sales["C"]["buyer"]) == (27, "Tensor AMM", "b")
    ledger = [r["tx"] for r in read_appended(spark, tables, "ledger").collect()]
    assert sorted(ledger) == sorted({r[0] for r in FIRST + SECOND})
    counters = {r["counter"]: r["n"] for r in read_latest(spark, tables, "counters").collect()}
    assert counters["MOVEMENT_STALE"] == 1 and counters["SALE"] == 2 and counters["RESTART_ASSET_UPDATES"] == 1

    ids = [r["tx_id"] for r in read_appended(spark, tables, "manifest").collect()]
    assert sorted(ids) == sorted({r[0] for r in FIRST + SECOND}), "each arrival is acknowledged once"

    with pytest.raises(UnresolvedBatch, match="sent without burn instruction"):
        run(spark, home, BROKEN)
    assert latest_version(spark, tables) == 1
    assert state(spark, home) == s
    kept = read_appended(spark, f"{home}/quarantine", "rows").collect()
    assert [(r["tx"], r["asset"], r["reason"]) for r in kept] == [("vanish", "C", "sent without burn instruction")]


def test_late_arrivals_wait_for_a_later_instant(spark):
    home = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    first, second = FIRST[0], FIRST[2]
    between = dt.datetime.fromtimestamp((first[1] + second[1]) / 2, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    assert run(spark, home, [first, second], between) == 0
    assert [r["tx"] for r in read_appended(spark, f"{home}/tables", "ledger").collect()] == ["lock-a"]
    assert reduce_again(spark, home) == 1
    assert sorted(r["tx"] for r in read_appended(spark, f"{home}/tables", "ledger").collect()) == ["lock-a", "sale-b"]
    assert reduce_again(spark, home) is None, "nothing is pending any more"


def reduce_again(spark, home):
    assets = spark.createDataFrame([(a,) for a in "ABCDE"], "asset string")
    far, past = F.lit("2100-01-01").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")
    return reduce_pending(spark, home, assets, far, past)


def test_new_checkpoint_loses_nothing(spark):
    home = f"{shared_dir(spark)}/fresh-{uuid.uuid4().hex}"
    for turn, rows in enumerate([[("a", 1)], [("b", 2)], [("b", 2), ("c", 3)]]):
        source = f"{home}/in-{turn}"
        spark.createDataFrame(rows, "tx string, seq bigint").write.parquet(source)
        stream = spark.readStream.schema("tx string, seq bigint").parquet(source)
        finish(run_ledger(stream, f"{home}/tables", f"{home}/checkpoint-{turn}", "tx", "seq"))
    assert sorted(r["tx"] for r in read_appended(spark, f"{home}/tables", "ledger").collect()) == ["a", "b", "c"]


def test_unreadable_commits_are_an_error(spark):
    home = f"{shared_dir(spark)}/torn-{uuid.uuid4().hex}"
    assert latest_version(spark, home) is None
    spark.createDataFrame([("x",)], "value string").write.text(f"{home}/commits/version=0")
    with pytest.raises(Exception, match="(?i)parquet"):
        latest_version(spark, home)


def test_conflicting_moves_stop_the_stream(spark):
    rows = spark.createDataFrame([(1, 5, 7, "u", 0), (1, 5, 8, "v", 0), (2, 5, 7, "u", 1), (2, 4, 9, "w", 0)], "asset bigint, seq bigint, tx bigint, owner string, burns bigint")
    with pytest.raises(ConflictingMoves, match="^1$"):
        agreed(keyed_state(rows, ["owner"]))
    got = agreed(keyed_state(rows.filter("asset = 2"), ["owner"])).collect()
    assert [tuple(r) for r in got] == [(2, 5, 7, "u", 1, 2)]


def test_gate_moves_its_cursor_inside_a_batch(spark):
    """Against a fold that keeps a cursor while it walks the batch."""
    import random

    rng = random.Random(3)
    moves = [(a, s, f"t{s:03d}", rng.randint(0, 9)) for a in "abcdef" for s in rng.sample(range(60), 15)]
    cursors = {"a": (20, "t020"), "b": (55, "t999")}
    expected, held = {}, dict(cursors)
    for a, s, t, ts in sorted(moves, key=lambda m: (m[1], m[2])):
        if a not in held:
            status = "COVERED_PRE_ACTIVATION" if ts <= 7 else "APPLY"
        elif s < held[a][0]:
            status = "STALE"
        elif s == held[a][0]:
            status = "DUPLICATE" if t == held[a][1] else "CONFLICT"
        else:
            status = "APPLY"
        if status == "APPLY":
            held[a] = (s, t)
        expected[a, t] = status
    df = spark.createDataFrame(moves, "asset string, seq bigint, tx string, ts int")
    seen = spark.createDataFrame([(a, *c) for a, c in cursors.items()], "asset string, last_seq bigint, last_tx string")
    got = {(r["asset"], r["tx"]): r["status"] for r in cursor_gate(df, seen, F.lit(7)).collect()}
    assert got == expected and {"COVERED_PRE_ACTIVATION", "APPLY", "STALE"} <= set(got.values())


def test_pushed_bodies(spark):
    one, two = X.tx("i" * 30, 1, T, "u", [X.restart("u")]), X.tx("j" * 30, 2, T, "u", [X.restart("u")])
    bodies = spark.createDataFrame([(one[4],), (f"[{one[4]}, {two[4]}, 5]",), ('{"signature": "short"}',)], "body string")
    rows = payload_rows(bodies, F.col("body")).select("tx_id", "pos", "slot").collect()
    assert sorted((r["tx_id"][0], r["pos"], r["slot"]) for r in rows) == [("i", 0, 1), ("i", 0, 1), ("j", 1, 2)]


def test_odd_shapes(spark):
    odd = [
        X.tx("two-senders", 1, T, "u", [], pre=[("p", "A", "s1", 1), ("q", "A", "s2", 1)], post=[("r", "A", "t", 2)]),
        X.tx("unreadable", 2, T, "u", [], pre=[("p", "A", "s1", "x")], post=[("p", "A", "s1", 0)]),
        X.tx("received", 3, T, "u", [], post=[("p", "A", "s1", 1)]),
        X.tx("replaced", 4, T, "u", [], pre=[("p", "A", "s1", 5), ("p", "A", "s1", 1)], post=[("p", "A", "s1", 1)]),
    ]
    scanned = scan_tx(frame(spark, odd), F.lit("2100-01-01").cast("timestamp"))
    moves = {r["tx"]: r for r in D.movement_rows(D.with_movements(D.decode_tx(scanned))).collect()}
    assert set(moves) == {"two-senders", "received"}
    assert moves["two-senders"]["from_owner"] is None and moves["two-senders"]["from_owners"] == ["s1", "s2"]
    assert moves["two-senders"]["to_owner"] == "t"
    assert moves["received"]["class"] == "MINT_OR_RECEIVE_FROM_ZERO"


def test_recovery_refuses_other_ids(spark):
    ids = spark.createDataFrame([("a" * 25,), ("b" * 25,)], "tx_id string")
    stated = batch_manifest(ids)
    assert sorted(r["tx_id"][0] for r in recover_batch(ids, stated).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="not those that were committed"):
        recover_batch(ids.limit(1), stated).collect()
