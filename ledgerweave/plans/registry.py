"""Registry of bound queries: a Spark plan over the test tables and, beside it, the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.plans.views import with_views
from ledgerweave.session import use_utc

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` may use the named views."""

    def register(fn: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
