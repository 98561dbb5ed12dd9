"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "monthly_activity",
    "market_kpis",
    "ledger_merge",
    "first_resale",
    "state_kpis",
    "holder_tiers",
    "burn_history",
    "row_index",
    "wallet_index",
    "market_flow",
    "rank_against",
    "wallet_portfolio",
    "latest_state",
    "cursor_gate",
    "restart_effects",
    "account_scd",
    "snapshot_diff",
    "backtest_compare",
    "batch_manifest",
    "sales_decode",
    "balance_movements",
    "product_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from ledgerweave.plans.catalog import QUERIES
    from ledgerweave.session import local_session

    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="bench")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("monthly_activity")  # starts executors and compiles common code
    seconds = {}
    for name in names:
        seconds[name] = round(run(name), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
