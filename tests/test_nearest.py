"""Searches along numbered rows, and restarts of a busy user whose call times fall, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import nearest as N
from ledgerweave.operators import restarts as X


@pytest.mark.parametrize("size", [3, 256])
def test_searches(spark, size):
    rng = random.Random(size)
    values = {key: [rng.randint(0, 9) for _ in range(n)] for key, n in (("a", 40), ("b", 1), ("c", 9))}
    rows = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "key string, n bigint, value bigint")
    blocks = N.Blocks(rows, "key", "n", "value", size)
    asks, want = [], {}
    for i in range(300):
        key = rng.choice("abcd")
        vs = values.get(key, [])
        start, least = rng.randint(-1, len(vs) + 1), rng.randint(0, 11)
        low, high = sorted((rng.randint(0, len(vs)), rng.randint(0, len(vs))))
        asks.append((i, key, start, least, low, high))
        after = [n for n in range(max(start, 0), len(vs)) if vs[n] >= least]
        before = [n for n in range(min(start, len(vs) - 1) + 1) if vs[n] >= least]
        top = max(range(low, high), key=lambda n: (vs[n], -n)) if low < high else None
        want[i] = (min(after, default=None), max(before, default=None), top)
    asks = spark.createDataFrame(asks, "id int, key string, start int, least int, low int, high int")
    got = blocks.first_at_least(asks, F.greatest("start", F.lit(0)), F.col("least"), "after")
    # A search backwards starts at a row.
    sizes = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, len(v) - 1)])
    got = blocks.last_at_least(got, F.least("start", F.coalesce(F.try_element_at(sizes, F.col("key")), F.lit(-1))), F.col("least"), "before")
    got = blocks.first_highest(got, ["id"], F.col("low"), F.col("high"), "top")
    assert {r["id"]: (r["after"], r["before"], r["top"]) for r in got.collect()} == want


def test_busy_user_with_falling_calls(spark, monkeypatch):
    """100,000 calls of one user that mostly fall in time, 10,000 open episodes: rows stay in proportion."""
    n, m, rng = 100_000, 10_000, random.Random(7)
    times = [10_000_000 - 50 * k + rng.randint(0, 4000) + (200_000 if k % 997 == 0 else 0) for k in range(n)]
    episodes = []
    for i in range(m):
        a = rng.randint(0, n - 1)
        b = rng.randint(a, n) if i % 3 else n
        episodes.append((f"asset-{i}", a, b, times[a] - rng.randint(0, 300_000), rng.choice([None, times[a] + rng.randint(-10_000, 10_000)])))
    # Plain walk over the links: the next call with a later time.
    later, stack = [n] * n, []
    for k in range(n):
        while stack and times[stack[-1]] < times[k]:
            later[stack.pop()] = k
        stack.append(k)
    want, through = {}, [0] * n
    for asset, a, b, lock, prior in episodes:
        floor = max(lock, prior + 1 if prior is not None else lock)
        k = a
        while k < b and times[k] < floor:
            k += 1
        path = []
        while k < b:
            path.append(k)
            through[k] += 1
            k = later[k]
        if path:
            want[asset] = (len(path), times[path[-1]], f"t{path[-1]}")
    rows = []
    for module in (X, N):
        real = module.settled
        monkeypatch.setattr(module, "settled", lambda df, real=real: rows.append((out := real(df)).count()) or out)
    asked = spark.createDataFrame([("u", k, f"t{k}", t, k) for k, t in enumerate(times)], "user string, seq bigint, tx string, t bigint, k bigint")
    spans = spark.createDataFrame(
        [("u", asset, a, f"s{a}", 1 << 62, lock, prior, a, b - a, 1) for asset, a, b, lock, prior in episodes],
        "user string, asset string, start_seq bigint, start_tx string, end_seq bigint, lock_ts bigint, prior_ts bigint, k0 bigint, inside bigint, strays_in int",
    )
    odd = X.stray_updates(asked, spans)
    got = {r["asset"]: (r["updates"], r["activity_ts"], r["activity_tx"]) for r in odd.episodes.collect()}
    assert got == want and max(u for u, *_ in want.values()) > 5
    assert {r["tx"]: r["_rough"] for r in odd.calls.collect()} == {f"t{k}": c for k, c in enumerate(through) if c}
    assert max(rows) <= n + m and sum(rows) < 20 * (n + m), rows


@pytest.mark.parametrize("calls", [2, 256])
def test_pairs_and_paths_agree(spark, calls):
    rng = random.Random(calls)
    asked, spans = [], []
    for u in range(30):
        n = rng.randint(1, 25)
        asked += [(f"u{u}", k, f"t{u}-{k}", rng.randint(0, 12), k) for k in range(n)]
        for i in range(rng.randint(0, 8)):
            a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
            lock = rng.choice([None, rng.randint(0, 9), 0])
            spans.append((f"u{u}", f"a{u}-{i}", a, rng.choice([None, "s"]), b, lock, rng.choice([None, rng.randint(0, 9)]), a, b - a, int(a < b)))
    asked = spark.createDataFrame(asked, "user string, seq bigint, tx string, t bigint, k bigint")
    spans = spark.createDataFrame(spans, "user string, asset string, start_seq bigint, start_tx string, end_seq bigint, lock_ts bigint, prior_ts bigint, k0 bigint, inside bigint, strays_in int")
    got = []
    for pairs in (-1, 10**9):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(X, "PAIRS", pairs)
            odd = X.stray_updates(asked, spans, calls=calls)
            got.append((sorted(map(repr, odd.episodes.collect())), sorted(map(repr, odd.calls.collect()))))
    assert got[0] == got[1] and len(got[0][0]) > 20
