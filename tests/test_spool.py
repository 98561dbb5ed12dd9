"""Wide frames of a batch: compressed while they are needed, gone behind it, and moved only where a key repeats."""

import os
import time
import uuid

from pyspark.sql import functions as F

from ledgerweave import constants as K
from ledgerweave.functions.ordered import keep_first
from ledgerweave.operators.decode import ledger_rows
from ledgerweave.plans.live_batch import decode_batch
from ledgerweave.session import SHUFFLES_END, remove, settled, shared_dir, spool
from ledgerweave.sources.tables import commit_version, read_appended
from ledgerweave.sources.tx_json import scan_tx
from ledgerweave.streaming import batches
from ledgerweave.streaming.batches import append_once, one_per_key, run_inbox
from tests import txkit as X
from tests.test_live_batch import FIRST, INBOX, SECOND, frame


def held(path):
    top = path.removeprefix("file:")
    return sum(os.lstat(f"{d}/{f}").st_size for d, _, names in os.walk(top) for f in names)


def test_landing_takes_a_part_of_the_text(spark):
    """2,000 rows of 10,000 characters: a checkpoint of the rows would hold 20 MB."""
    rows = spark.range(2000, numPartitions=4).select(
        F.concat(F.lit("tx-"), F.col("id").cast("string")).alias("tx_id"), F.col("id").alias("slot"),
        F.concat(F.lit('{"keys":"'), F.repeat(F.lit("key,"), 2498), F.col("id").cast("string"), F.lit('"}')).alias("payload"),
    )
    home = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    before = held(shared_dir(spark))
    append_once(rows, home, "tx_id", "slot", "rows")
    assert held(shared_dir(spark)) - before < 5_000_000
    assert not [n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith("spool-")]
    assert read_appended(spark, home, "rows").exceptAll(rows).count() == 0
    assert read_appended(spark, home, "rows").count() == 2000


def test_spool_is_deleted_after_an_error(spark):
    try:
        with spool(spark) as keep:
            assert keep(spark.range(3)).count() == 3
            raise KeyError
    except KeyError:
        pass
    assert not [n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith("spool-")]


def test_one_row_a_key(spark):
    """Repeated and null keys, and null values, as ``keep_first`` over all rows."""
    rows = [("a", 2, "y"), ("a", 1, "z"), ("b", None, "x"), ("b", 3, None), (None, 5, "p"), (None, 4, "q"), ("c", 7, "one"), ("d", None, None)]
    df = spark.createDataFrame(rows, "k string, n bigint, t string")
    with spool(spark) as keep:
        got = sorted(map(tuple, one_per_key(df, "k", keep).collect()), key=repr)
    assert got == sorted(map(tuple, keep_first(df, ["k"], ["n", "t"]).collect()), key=repr) and len(got) == 5


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_shuffle_files_go_with_the_query(spark):
    """Frames held in a spool, checkpoints and plain actions: no shuffle file is left, and the setting is as it was."""
    before = shuffle_files(spark)
    rows = spark.range(0, 20_000, 1, 8).selectExpr("id % 7 AS k", "id AS v", "repeat('x', 100) AS t")
    with spool(spark) as keep:
        totals = keep(rows.groupBy("k").agg(F.sum("v").alias("n"), F.max("t").alias("t")))
        again = settled(rows.repartition(5, "v").join(totals.select("k", "n"), "k"))
        assert again.count() == 20_000 and totals.agg(F.sum("n")).first()[0] == 199_990_000
        for _ in range(100):
            left = shuffle_files(spark) - before
            if not left:
                break
            time.sleep(0.1)
        assert not left
    assert spark.conf.get(SHUFFLES_END) == "false"
    assert again.agg(F.sum("v")).first()[0] == 199_990_000


def test_calls_nothing_reads_are_not_held(spark):
    """Of a decoded batch only custody calls and burns stay; royalties, sales and burn checks are as before."""
    scanned = scan_tx(frame(spark, FIRST + SECOND[:2]), F.lit("2100-01-01").cast("timestamp"))
    rows = {r["tx_id"]: r for r in decode_batch(scanned).collect()}
    programs = {i: [c["program"] for c in r["calls"]] for i, r in rows.items()}
    assert not programs["sale-b"] and not programs["sale-c"] and not programs["sale-e"]
    assert programs["lock-a"] == [K.CUSTODY_PROGRAM] and len(programs["restart-u"]) == 2 and programs["burn-d"][0] in K.TOKEN_PROGRAMS
    assert int(rows["sale-b"]["royalty"]) == 900 and rows["sale-c"]["sales"][0]["asset"] == "C" and not rows["sale-e"]["undecodable"]


def test_decoded_rows_are_gone_before_the_commit(spark, monkeypatch):
    """When the outputs are written, no frame that the commit does not read is left, nor are arrivals that have landed."""
    home = f"{shared_dir(spark)}/brief-{uuid.uuid4().hex}"
    frame(spark, FIRST).coalesce(1).write.parquet(f"{home}/in")
    held_columns, arrived = [], []

    def commit(session, root, frames, *rest):
        if root == f"{home}/tables":
            top = shared_dir(session).removeprefix("file:")
            for name in os.listdir(top):
                if name.startswith("spool-"):
                    held_columns.extend(session.read.parquet(f"{top}/{name}/{part}").columns for part in os.listdir(f"{top}/{name}"))
            arrived.append(os.path.exists(f"{home}/in".removeprefix("file:")))
        return commit_version(session, root, frames, *rest)

    def commit_named(session, root, frames, *rest, span=None):
        return commit(session, root, frames, *rest, *([] if span is None else [None, None, span]))

    monkeypatch.setattr(batches, "commit_version", commit_named)
    assets = spark.createDataFrame([(a,) for a in "ABCDE"], "asset string")
    stream = spark.readStream.schema(INBOX).parquet(f"{home}/in")
    at = lambda text: F.lit(text).cast("timestamp")
    run_inbox(stream, home, f"{home}/checkpoint", assets, at("2100-01-01"), at("2000-01-01"), landed=lambda: remove(spark, f"{home}/in"))
    assert arrived == [False] and held_columns and not any("movements" in c and "royalty" in c for c in held_columns)
    ledger = {r["tx"]: r for r in read_appended(spark, f"{home}/tables", "ledger").collect()}
    assert set(ledger) == {r[0] for r in FIRST} and ledger["sale-b"]["movements"] == "B:TRANSFER" and ledger["sale-b"]["sales"] == "B:Magic Eden V2"
    assert ledger["restart-u"]["restart_updates"] == 1 and ledger["lock-a"]["received_at"] is not None


def test_ledger_names_known_assets_only(spark):
    """A known and an unknown asset in one transaction, an unknown alone, and a failed one."""
    pair = X.moved("A", "s", "t"), X.moved("Z", "s", "t")
    both = {side: [*pair[0][side], *pair[1][side]] for side in ("pre", "post")}
    rows = [X.tx("both", 40, 1, "s", [], **both), X.tx("foreign", 41, 2, "s", [], **pair[1]), *FIRST[2:]]
    decoded = decode_batch(scan_tx(frame(spark, rows), F.lit("2100-01-01").cast("timestamp")))
    assets = spark.createDataFrame([("A",), ("B",), ("D",)], "asset string")
    with spool(spark) as keep:
        got = {r["tx"]: (r["movements"], r["sales"]) for r in ledger_rows(keep(decoded), assets, ["received_at"], keep).collect()}
    assert got == {
        "both": ("A:TRANSFER", ""), "foreign": ("", ""), "sale-b": ("B:TRANSFER", "B:Magic Eden V2"),
        "burn-d": ("D:BURN_OR_SEND_TO_ZERO", ""), "failed": ("", ""),
    }
