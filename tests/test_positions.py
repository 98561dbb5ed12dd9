"""Positions over sealed ranges: equal to a sort of all rows after each batch, and only touched ranges are written anew."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import wallets as W
from ledgerweave.session import shared_dir
from ledgerweave.sources import positions as P
from ledgerweave.sources.tables import latest_version

KEYS = ["ts", "tx"]


def add(spark, root, rows, batch):
    df = spark.createDataFrame(rows, "ts bigint, tx string, buyer string, seller string")
    return P.append_ordered(spark, root, df, KEYS, F.expr("ts div 50"), 10, {"wallets": W.wallet_places}, "s", batch)


def check(spark, root, rows):
    want = sorted(set(rows))
    got = sorted(tuple(r) for r in P.read_positions(spark, root).select("idx", "ts", "tx").collect())
    assert got == [(i, r[0], r[1]) for i, r in enumerate(want)]
    lists = {}
    for i, (_, _, buyer, seller) in enumerate(want):
        for wallet, kind in ((buyer, "buy"), (seller, "sell")):
            if wallet is not None:
                lists.setdefault((wallet, kind, i // 7), []).append(i)
    index = W.placed_index(P.read_ranges(spark, root, "wallets"), 7)
    assert {(r["wallet"], r["kind"], r["piece"]): r["positions"] for r in index.collect()} == lists


def folders(root, name):
    return {(v, r) for v in os.listdir(f"{root}/{name}") if v.startswith("made=") for r in os.listdir(f"{root}/{name}/{v}") if r.startswith("rid=")}


def alive(spark, root):
    return {(f"made={r['made']}", f"rid={r['rid']}"): r["n"] for r in P.range_bases(spark, root).collect()}


@pytest.fixture(scope="module")
def root(spark):
    return f"{shared_dir(spark)}/positions-{uuid.uuid4().hex}"


def test_late_rows_move_positions_not_rows(spark, root):
    rng = random.Random(8)
    person = lambda: rng.choice(["hot", "hot", None, f"w{rng.randint(0, 5)}"])
    make = lambda ts, tx: (ts, tx, person(), person())
    assert add(spark, root, [], 0) == 0
    assert P.read_positions(spark, root).collect() == [] and P.read_ranges(spark, root, "wallets").collect() == []

    # Many rows share a time, so the second key decides; 20 in one time fill more than a range.
    rows = [make(rng.choice([50, rng.randint(0, 400)]), f"t{i:03d}") for i in range(120)] + [make(77, f"u{i}") for i in range(20)]
    add(spark, root, rows + rows[:30], 1)
    check(spark, root, rows)
    before = alive(spark, root)
    assert len(before) == 14 and sum(before.values()) == 140 and all(10 <= n < 20 for n in before.values())

    # One row before all others, some late ones at one place, and rows that are stored already in other places.
    late = [make(-5, "first"), *[make(77, f"x{i}") for i in range(3)]]
    add(spark, root, late + rows[:60], 2)
    check(spark, root, rows + late)
    after = alive(spark, root)
    assert len(before.keys() - after.keys()) == 2, "only the first range and that of time 77 are replaced"
    assert all(after[k] == n for k, n in before.items() if k in after)
    assert before.keys() <= folders(root, P.ROWS), "a reader of the commit before still finds its ranges"

    # Repeats alone write nothing; the batch after deletes what was replaced; a batch is taken once.
    version = add(spark, root, rows[:10], 3)
    assert alive(spark, root) == after and add(spark, root, [make(9, "again")], 3) == version == latest_version(spark, root)
    assert folders(root, P.ROWS) == folders(root, "wallets") | set(after) == set(after)

    # A batch at the end that is far larger than a range.
    more = [make(500 + i // 9, f"v{i:03d}") for i in range(95)]
    add(spark, root, more, 4)
    check(spark, root, rows + late + more)
    assert max(alive(spark, root).values()) < 20
    page = P.read_positions(spark, root, 100, 104)
    want = sorted(set(rows + late + more))[100:105]
    assert sorted((r["ts"], r["tx"]) for r in page.collect()) == [(r[0], r[1]) for r in want]
    assert 1 <= len([f for f in page.inputFiles() if f"/{P.ROWS}/" in f]) <= 2
