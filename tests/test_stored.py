"""Frames that are read again take a part of a checkpoint, leave no shuffle files, and inputs are read once."""

import datetime as dt
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerweave import session
from ledgerweave.functions.ordered import dense_index
from ledgerweave.plans import bound_products, bound_stream, bound_wallets
from ledgerweave.plans import views as V
from ledgerweave.session import SHUFFLES_END, shared_dir, stored
from ledgerweave.sources.tables import read_latest
from tests.test_spool import shuffle_files


@pytest.fixture
def top(spark, monkeypatch):
    """A shared folder that nothing else writes to."""
    own = f"{shared_dir(spark).removeprefix('file:')}/own-{uuid.uuid4().hex}"
    os.makedirs(own)
    for module in (session, bound_stream):
        monkeypatch.setattr(module, "shared_dir", lambda spark: own)
    return own


def held(top):
    return {f"{d}/{f}": os.lstat(f"{d}/{f}").st_size for d, _, names in os.walk(top) for f in names}


def tables(spark, folder):
    """Orders of 40 days with lines that repeat, tie and name unknown orders; a buyer without a customer; null keys."""
    day = lambda i: dt.datetime(1998, 12, 20) + dt.timedelta(days=i * 20)
    priority = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    orders = [(i, i % 7, day(i), 100.5 + i, priority[i % 4]) for i in range(40)]
    lines = [(i, n, n % 3, (i * n) % 11, 10.25 * n + i, 0.04, "ARN"[i % 3], "FO"[n % 2], day(i)) for i in range(40) for n in (1, 2, 3, 5)]
    lines += [*lines[:5], (3, 1, 2, 3, 1.0, 0.01, "A", "F", day(3)), (99, 1, 1, 1, 5.0, 0.0, "N", "O", day(1)), (5, 9, None, None, 5.0, 0.0, "N", "O", None)]
    frames = {
        "orders": spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_totalprice double, o_orderpriority string"),
        "lineitem": spark.createDataFrame(
            lines,
            "l_orderkey bigint, l_linenumber bigint, l_suppkey bigint, l_partkey bigint, l_extendedprice double, l_tax double,"
            " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        ),
        "part": spark.createDataFrame([(i, "PROMO TIN" if i % 2 else "SMALL TIN") for i in range(12)], "p_partkey bigint, p_type string"),
        "customer": spark.createDataFrame([(i, i % 2) for i in range(6)], "c_custkey bigint, c_nationkey bigint"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_stored_rows_are_small_and_leave_no_shuffle(spark, top):
    files = shuffle_files(spark)
    rows = stored(spark.range(0, 100_000, 1, 4).select("id", F.lit("buy").alias("kind"), F.lit(None).cast("string").alias("none")).repartition(3, "id"))
    assert 0 < sum(held(top).values()) < 2_000_000
    for _ in range(100):
        left = shuffle_files(spark) - files
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(SHUFFLES_END) == "false"
    assert rows.agg(F.sum("id"), F.count("none")).first()[:] == (4_999_950_000, 0)


def test_positions_are_stored_in_columns(spark, top):
    rows = spark.createDataFrame([(i * 7 % 100, "x") for i in range(100)], "k bigint, t string")
    got = dense_index(rows, ["k"]).collect()
    assert all(r["idx"] == r["k"] for r in got) and len(got) == 100
    assert {f.split("-")[0] for f in os.listdir(top)} == {"stored"}


def test_products_read_lines_once_and_leave_their_tables(spark, top, monkeypatch):
    folder = tables(spark, f"{top}/tables")
    read, table = [], V.table
    monkeypatch.setattr(V, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    before = held(top)
    root = bound_products.build(spark, folder)
    assert read.count("lineitem") == 1
    left = set(held(top)) - set(before)
    assert left and all(root in f or "/stored-" in f for f in left)
    keys = {(r[0], r[1]) for r in V.sales(spark, folder).select("tx", "asset").collect()}
    assert read_latest(spark, root, "sales").count() == len(keys) > 100


def test_trades_without_idle_columns(spark, top):
    """The first line of a sale is the one that all columns give, and only matched trades stay behind a timeline."""
    folder = tables(spark, f"{top}/tables")
    cols = ["tx", "asset", "ts", "buyer", "seller", "price"]
    read = lambda df: sorted(map(repr, df.select(*cols).collect()))
    narrow = bound_wallets.narrow_sales(spark, folder)
    assert read(narrow) == read(V.sales(spark, folder)) and "l_shipdate" not in narrow._jdf.queryExecution().executedPlan().toString()
    before = set(os.listdir(top))
    rows = bound_wallets.timed(spark, folder).collect()
    assert {r["kind"] for r in rows} >= {"mint", "buy", "sell"} and len(rows) > 100
    new = [f for f in os.listdir(top) if f not in before]
    assert len(new) == 2 and all(f.startswith("stored-") for f in new), "matched trades and the positions of mints"
