"""Compare bound queries with their SQL: ``python tools/check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerweave.plans.catalog import ORACLES, QUERIES  # noqa: E402
from ledgerweave.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return f"rows-only {len(got)}"
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"DIFF {len(got)} vs {len(want)}\n   spark only {sorted(a - b)[:3]}\n   sql only   {sorted(b - a)[:3]}"
    kinds = dict(df.dtypes)
    return f"ok {len(got)} {kinds}" if os.environ.get("TYPES") else f"ok {len(got)}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            outcome = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            outcome = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        bad += not outcome.startswith(("ok", "rows-only"))
        print(f"{name:24s} {time.time() - start:6.2f}s {outcome}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
