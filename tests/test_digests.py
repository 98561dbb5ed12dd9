"""Comparison by digest tree: nothing is read for equal versions, one bucket for one changed row."""

import random
import uuid

import pytest

from ledgerweave.session import shared_dir
from ledgerweave.sources import digests as D

SCHEMA = "asset bigint, owner string, price bigint"


def store(spark, rows, buckets=64):
    path = f"{shared_dir(spark)}/digest-{uuid.uuid4().hex}"
    D.write_digested(spark.createDataFrame(rows, SCHEMA).repartition(3), path, ["asset"], buckets)
    return path


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, rng.choice(["a", "b", None]), rng.choice([None, i])) for i in range(3000)]


@pytest.fixture(scope="module")
def first(spark, rows):
    return store(spark, rows)


def test_equal_versions(spark, rows, first):
    again = store(spark, rows[::-1])
    assert D.unequal_buckets(spark, first, again) == []
    changes = D.version_changes(spark, first, again, ["asset"])
    assert changes.isEmpty()
    tree = spark.read.parquet(f"{first}/tree").collect()
    assert {r["level"]: r["n"] for r in tree if r["level"] == 2} == {2: 3000} and len(tree) == 64 + 4 + 1


@pytest.mark.parametrize("change", [(17, "z", 17), (17, None, None), None, (9999, "new", 1)])
def test_one_row(spark, rows, first, change):
    other = [r for r in rows if r[0] != 17] if change is None or change[0] == 17 else list(rows)
    path = store(spark, other + ([change] if change else []))
    buckets = D.unequal_buckets(spark, first, path)
    assert len(buckets) == 1
    read = D.version_rows(spark, first, buckets)
    assert read.count() < 3000 / 20
    want = "removed" if change is None else "added" if change[0] == 9999 else "changed"
    got = [tuple(r) for r in D.version_changes(spark, first, path, ["asset"]).collect()]
    assert got == ([(change[0] if change else 17, want)] if change != rows[17] else [])


def test_many_changes_and_an_empty_version(spark, rows, first):
    rng = random.Random(2)
    other = {r[0]: r for r in rows}
    want = {}
    for i in rng.sample(range(3000), 200):
        if i % 3 == 0:
            del other[i]
            want[i] = "removed"
        else:
            other[i] = (i, "changed", -1)
            want[i] = "changed"
    got = D.version_changes(spark, first, store(spark, list(other.values())), ["asset"])
    assert {r["asset"]: r["status"] for r in got.collect()} == want
    few = store(spark, rows[:1])
    assert D.version_changes(spark, few, first, ["asset"]).count() == 2999
    assert {r["status"] for r in D.version_changes(spark, store(spark, []), few, ["asset"]).collect()} == {"added"}
    assert D.unequal_buckets(spark, store(spark, []), store(spark, [])) == []
