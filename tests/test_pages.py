"""Pages by cursor: all pages together are the list, pages by number agree, and a page reads the files of its set."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import pages as P
from ledgerweave.session import shared_dir

KEYS = ["late", "idx"]


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(6)
    sizes = {"busy": 900, "a": 30, "b": 1, "c": 25, "d": 24, "zero-like": 26}
    rows = [(s, -rng.randint(0, 400), i, rng.choice(["buy", "sell", "mint"])) for s, n in sizes.items() for i in range(n)]
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    df = spark.createDataFrame(rows, "set_id string, late bigint, idx bigint, kind string").repartition(5)
    P.write_pages(df, path, "set_id", KEYS, 25, F.expr("late div 50"), files=8)
    return path, rows


def walk(spark, path, set_id, where=None):
    out, cursor, turns = [], None, 0
    while True:
        page, cursor = P.read_page(spark, path, "set_id", KEYS, set_id, 25, cursor, where=where)
        out.append([tuple(r) for r in page.collect()])
        turns += 1
        if cursor is None:
            return out


def test_pages_by_cursor(spark, stored):
    path, rows = stored
    for set_id in ("a", "b", "c", "d", "zero-like"):
        want = sorted((r for r in rows if r[0] == set_id), key=lambda r: r[1:3])
        got = walk(spark, path, set_id)
        assert [r for p in got for r in p] == want and [len(p) for p in got[:-1]] == [25] * (len(got) - 1)
    assert walk(spark, path, "nobody") == [[]]
    mints = walk(spark, path, "busy", F.col("kind") == "mint")
    assert [r for p in mints for r in p] == sorted((r for r in rows if r[0] == "busy" and r[3] == "mint"), key=lambda r: r[1:3])


def test_pages_by_number(spark, stored):
    path, rows = stored
    want = sorted((r for r in rows if r[0] == "busy"), key=lambda r: r[1:3])
    for number in (1, 7, 36):
        page, cursor = P.read_page(spark, path, "set_id", KEYS, "busy", 25, page=number)
        assert [tuple(r) for r in page.collect()] == want[25 * number - 25 : 25 * number]
        assert (cursor is None) == (number == 36)
    assert P.read_page(spark, path, "set_id", KEYS, "busy", 25, page=37)[0].isEmpty()
    index = {(r["set_id"], r["page"]): (r["late"], r["idx"], r["n"]) for r in spark.read.parquet(f"{path}/pages").collect()}
    assert index["busy", 7] == (*want[150][1:3], 25) and index["zero-like", 2][2] == 1 and ("c", 2) not in index


def test_files_of_the_set_only(spark, stored):
    path, _ = stored
    every = len(spark.read.parquet(f"{path}/rows").inputFiles())
    one, _ = P.read_page(spark, path, "set_id", KEYS, "c", 25)
    assert len(one.inputFiles()) <= 2 < every
