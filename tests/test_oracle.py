"""Every bound query at the smallest scale against its SQL."""

import pytest

from ledgerweave.plans.catalog import ORACLES, QUERIES
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    outcome = compare(spark, con, name, SF_DIR)
    assert outcome.startswith("ok"), outcome
