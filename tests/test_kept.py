"""Products kept up to date: after each batch they equal the full build, and a batch writes what it touches."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import holders as H
from ledgerweave.operators import kept as K
from ledgerweave.operators import market as M
from ledgerweave.session import shared_dir
from ledgerweave.sources.tables import latest_version, read_latest

T0 = datetime(2024, 1, 1)
NOW = datetime(2025, 6, 1)
STATE = "asset bigint, category string, owner string, burned bigint, burn_ts timestamp_ntz, locked bigint, activity_ts timestamp_ntz"
SALE = "tx bigint, asset bigint, buyer string, ts timestamp_ntz, price bigint, royalty bigint, origin timestamp_ntz, opening boolean"


def some_state(rng, asset):
    burned, locked = int(rng.random() < 0.2), int(rng.random() < 0.5)
    owner = None if burned or rng.random() < 0.1 else f"w{rng.choice([0, 0, 0, rng.randint(1, 9)])}"
    at = T0 + timedelta(days=rng.randint(0, 500), seconds=rng.choice([0, 1]))
    return (asset, rng.choice(["a", "b", None]), owner, burned, at if burned else None, locked, at if locked and rng.random() < 0.7 else None)


def some_sale(rng, tx, opening):
    ts = None if rng.random() < 0.05 else T0 + timedelta(days=rng.randint(0, 400))
    return (tx, rng.randint(0, 59), rng.choice(["x", "y", None, f"b{rng.randint(0, 20)}"]), ts, rng.choice([None, 2**62, 5]), rng.randint(0, 9), T0, opening)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def equal_to_full(spark, root, states, sales):
    s = spark.createDataFrame(list(states.values()), STATE)
    ledger = spark.createDataFrame(sales, SALE)
    pairs = [
        (K.kept_state_kpis(spark, root, F.lit(NOW)), H.state_kpis(s, F.lit(NOW))),
        (K.kept_holder_balances(spark, root), H.holder_balances(s)),
        (K.kept_holder_tiers(spark, root), H.holder_tiers(s)),
        (K.kept_activity_buckets(spark, root, F.lit(NOW)), H.activity_buckets(s, F.lit(NOW))),
        (K.kept_burned_by_category(spark, root, ["a", "b"]), H.burned_by_category(s, ["a", "b"])),
        (K.kept_market_kpis(spark, root, F.lit(7.0), 2, 4), M.market_kpis(ledger, F.lit(7.0), 2, 4)),
        (K.kept_monthly_activity(spark, root, 2, 4), M.monthly_activity(ledger, 2, 4)),
        (K.kept_daily_activity(spark, root, 2), M.daily_activity(ledger, 2)),
        (K.kept_first_resale(spark, root), M.first_resale(s.select("asset", F.lit(T0).cast("timestamp_ntz").alias("origin")), ledger.filter("opening"), ledger.filter("NOT opening"))),
    ]
    for got, want in pairs:
        assert got.columns == want.columns
        assert rows(got) == rows(want), got.columns


def test_batches_equal_full_build(spark):
    rng = random.Random(3)
    root = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    states = {a: some_state(rng, a) for a in range(60)}
    sales = [some_sale(rng, tx, True) for tx in range(150)]
    opening = K.signed_changes(None, spark.createDataFrame(list(states.values()), STATE))
    K.refresh(spark, root, opening, spark.createDataFrame(sales, SALE), "s", 0)
    equal_to_full(spark, root, states, sales)

    # A late base sale, live sales, and assets that change owner, burn or lose their lock.
    moved = rng.sample(range(60), 12)
    before = spark.createDataFrame([states[a] for a in moved], STATE)
    states.update({a: some_state(rng, a) for a in moved})
    after = spark.createDataFrame([states[a] for a in moved], STATE)
    fresh = [(1000, 59, "new", T0 - timedelta(days=0), 3, 1, T0, True)] + [some_sale(rng, 1001 + i, False) for i in range(25)]
    changes = K.signed_changes(before, after)
    version = K.refresh(spark, root, changes, spark.createDataFrame(fresh, SALE), "s", 1)
    sales += fresh
    equal_to_full(spark, root, states, sales)

    # The version holds entries of what the batch names only; all that it brings is read once.
    named = {r[0] for r in changes.select("owner").collect()} | {r[2] for r in fresh} | {str(r[1]) for r in fresh}
    written = spark.read.parquet(f"{root}/members/version={version}").filter("name <> 'activity'")
    assert {r["item"] for r in written.collect()} <= named
    assert {r["asset"] for r in spark.read.parquet(f"{root}/firsts/version={version}").collect()} <= {str(r[1]) for r in fresh}

    # The same batch again is not taken, and an empty one changes no figure.
    assert K.refresh(spark, root, changes, spark.createDataFrame(fresh, SALE), "s", 1) == version
    K.refresh(spark, root, changes.limit(0), spark.createDataFrame([], SALE), "s", 2)
    assert latest_version(spark, root) == version + 1
    equal_to_full(spark, root, states, sales)


def test_numbers_that_reach_zero_are_dropped_by_a_fold(spark):
    root = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    row = lambda owner: spark.createDataFrame([(1, "a", owner, 0, None, 0, None)], STATE)
    K.refresh(spark, root, K.signed_changes(None, row("w0")), None, "s", 0)
    for turn in range(1, 11):
        K.refresh(spark, root, K.signed_changes(row(f"w{turn - 1}"), row(f"w{turn}")), None, "s", turn)
    assert rows(K.kept_holder_balances(spark, root)) == [("w10", 1)]
    assert K.kept_state_kpis(spark, root, F.lit(NOW)).first()["holders"] == 1
    assert read_latest(spark, root, "members").count() < 6
    with pytest.raises(Exception, match="taken away more often than counted"):
        K.refresh(spark, root, K.signed_changes(row("nobody"), row("w0")), None, "s", 11)
    assert latest_version(spark, root) == 10
