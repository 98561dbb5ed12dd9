"""What a batch reads and writes follows the batch: files and bytes over ten batches, late rows, expiry, stops half-way."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerweave.session import shared_dir
from ledgerweave.sources import tables as T
from ledgerweave.streaming import batches as B

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROWS = "tx_id string, received_at timestamp, seq bigint, status string, source string"


def local(path):
    return path.removeprefix("file:")


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(local(path)) for f in names if f.endswith(".parquet"))


def versions(path):
    return sorted(int(n.removeprefix("version=")) for n in os.listdir(local(path)) if n.startswith("version="))


def test_intake_reads_open_rows_only(spark):
    """Ten landings and snapshots. Two rows of each belong to the next instant, and one comes very late."""
    home = f"{shared_dir(spark)}/cost-{uuid.uuid4().hex}"
    at = lambda i, minute: T0 + dt.timedelta(hours=i, minutes=minute)
    files, taken = [], []
    for i in range(10):
        rows = [(f"tx-{i:02d}-{k}", at(i, k), 100 * i + k, "pending" if k % 3 else "failed", "hook") for k in range(8)]
        rows.append((f"late-{i:02d}", at(0, 1), 5 + 1000 * i, "pending", "hook"))
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{home}/in/{i}")
        stream = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{home}/in")
        B.finish(B.run_ledger(stream, f"{home}/tables/inbox", f"{home}/checkpoint", "tx_id", "seq", "rows"))
        seen, mark = B.candidates(spark, f"{home}/tables/inbox", f"{home}/tables/snapshots", "marks")
        assert mark == i
        files.append(len(seen.inputFiles()))
        got = B.run_snapshot(stream, F.lit(at(i, 5)), f"{home}/tables", f"{home}/checkpoint")
        taken.append({r["tx_id"] for r in got.collect()})
    for i in range(10):
        assert taken[i] == {f"late-{i:02d}", *(f"tx-{i:02d}-{k}" for k in (1, 2, 4, 5)), *((f"tx-{i - 1:02d}-7",) if i else ())}
    assert max(files[1:]) <= files[1] + 1, files
    held = T.read_overlapping(spark, f"{home}/tables/inbox", "rows", "seq", 300, 305)
    assert {r["seq"] for r in held.collect()} == set(range(300, 306))
    assert len(held.inputFiles()) < len(T.read_appended(spark, f"{home}/tables/inbox", "rows").inputFiles()) / 2


def test_tables_by_change(spark):
    """Ten batches change five of 4,000 rows each; same rows as a table that is rewritten."""
    root = f"{shared_dir(spark)}/change-{uuid.uuid4().hex}"
    rng = random.Random(1)
    want = {i: (i, f"owner-{i}", i % 3, 0) for i in range(4000)}
    frame = lambda rows: spark.createDataFrame(rows, "asset bigint, owner string, locked int, turn int")
    T.commit_version(spark, root, {"state": T.ByChange(frame(list(want.values())), "asset"), "log": (frame([want[0]]), ["asset"])})
    for turn in range(1, 11):
        changed = [(a, None if turn % 2 else f"new-{turn}", turn, turn) for a in [*rng.sample(range(4000), 4), 4000 + turn]]
        want |= {r[0]: r for r in changed}
        T.commit_version(spark, root, {"state": T.ByChange(frame(changed), "asset"), "log": (frame(changed), ["asset"])}, "s", turn)
        assert {tuple(r) for r in T.read_latest(spark, root, "state").collect()} == set(want.values())
    whole = size(f"{root}/state/version=9")
    small = [size(f"{root}/state/version={v}") for v in (*range(1, 9), 10)]
    assert max(small) < whole / 4 and max(small) < 1.5 * min(small), "bytes follow the batch, but for the fold of version 9"
    assert versions(f"{root}/state") == list(range(11)), "the base before the last one stays for readers that have found it"
    assert T.read_appended(spark, root, "log").count() == 51
    assert T.is_committed(spark, root, "s", 10) and not T.is_committed(spark, root, "s", 11) and not T.is_committed(spark, root, "other", 0)


def test_expiry_and_a_stop_half_way(spark, monkeypatch):
    monkeypatch.setattr(T, "FOLD_EVERY", 2)
    root = f"{shared_dir(spark)}/expire-{uuid.uuid4().hex}"
    frame = lambda v: spark.createDataFrame([(1, v), (v + 10, v)], "k int, v int")
    for v in range(9):
        assert T.commit_version(spark, root, {"state": T.ByChange(frame(v), "k"), "log": (frame(v), ["k"])}, "s", v, (v, v)) == v
    assert versions(f"{root}/state")[0] == 3 and versions(f"{root}/commits")[0] == 6, "bases at 0, 3 and 6"
    want = {(1, 8), *((v + 10, v) for v in range(9))}
    assert {tuple(r) for r in T.read_latest(spark, root, "state").collect()} == want
    assert T.read_appended(spark, root, "log").count() == 18 and T.is_committed(spark, root, "s", 0)
    assert sorted(r["v"] for r in T.read_overlapping(spark, root, "log", "v", 2, 3).collect()) == [2, 2, 3, 3]
    # A version that was written but never committed is invisible, and the next attempt takes its number.
    broken = spark.createDataFrame([(1, 99)], "k int, v int").withColumn("v", F.when(F.col("k") == 1, F.raise_error(F.lit("stop"))).cast("int"))
    with pytest.raises(Exception, match="stop"):
        T.commit_version(spark, root, {"state": T.ByChange(frame(99), "k"), "log": (broken, ["k"])}, "s", 9)
    assert {tuple(r) for r in T.read_latest(spark, root, "state").collect()} == want
    assert T.commit_version(spark, root, {"state": T.ByChange(frame(9), "k"), "log": (frame(9), ["k"])}, "s", 9) == 9
    assert {tuple(r) for r in T.read_latest(spark, root, "state").collect()} == {(1, 9), *((v + 10, v) for v in range(10))}
