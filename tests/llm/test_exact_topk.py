"""Exact top-k search against all inner products."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerweave.llm import exact_topk
from ledgerweave.llm.queries import op12


def plain(queries, rows, k):
    best = defaultdict(dict)
    low, high = -(1 << 63), (1 << 63) - 1
    for q, own in queries:
        for i, other in rows:
            if i != q:
                score = min(max(sum(w * other.get(t, 0) for t, w in own.items()), low), high)
                best[q][i] = max(best[q].get(i, low), score)
    return {(q, r, i, s) for q, found in best.items() for r, (s, i) in enumerate(sorted((-s, i) for i, s in found.items())[:k], 1) for s in [-s]}


def tuples(df):
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def sparse(spark, rows):
    return spark.createDataFrame([(i, list(v), [float(x) for x in v.values()], "z") for i, v in rows], "id long, terms array<int>, weights array<double>, block string")


@pytest.mark.parametrize(("n_queries", "n_rows", "n_group"), [(1024, 8192, 1 << 17), (5, 16, 40)])
def test_blocks_and_groups(spark, monkeypatch, n_queries, n_rows, n_group):
    monkeypatch.setattr(exact_topk, "QUERIES", n_queries)
    monkeypatch.setattr(exact_topk, "ROWS", n_rows)
    monkeypatch.setattr(exact_topk, "GROUP_ROWS", n_group)
    rng = random.Random(n_rows)
    rows = [(i, {t: rng.choice([-3, -1, 1, 2]) for t in rng.sample(range(12), rng.randint(0, 8))}) for i in range(150)]
    rows += [(i, dict(v)) for i, v in rows[:30]]  # repeated rows
    rows += [(7, {t: rng.choice([1, 2]) for t in range(12)}) for _ in range(60)]  # one id in many rows
    queries = rows[::9]
    assert tuples(exact_topk.top_k(sparse(spark, queries), sparse(spark, rows).repartition(5), 6)) == plain(queries, rows, 6)


def test_no_rows(spark):
    some, none = sparse(spark, [(1, {0: 1}), (2, {})]), sparse(spark, [(1, {0: 1})]).limit(0)
    assert exact_topk.top_k(none, some, 3).isEmpty()
    assert exact_topk.top_k(some, none, 3).isEmpty()
    assert tuples(exact_topk.top_k(some, some, 3)) == {(1, 1, 2, 0), (2, 1, 1, 0)}


def test_repeated_terms(spark):
    df = spark.createDataFrame([(1, [3, 3, 5], [1.0, 2.0, 1.0]), (2, [3, 3], [4.0, -9.0]), (3, [5], [2.0])], "id long, terms array<int>, weights array<double>")
    assert tuples(exact_topk.top_k(df, df, 2)) == plain(*[[(1, {3: 3, 5: 1}), (2, {3: -5}), (3, {5: 2})]] * 2, 2)


def test_query_on_unusual_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = [(int(i), rng.normal(0, 0.2, 6).round(2).tolist()) for i in range(70)]
    vectors += [(100, None), (101, [1.0, None, 0.0]), (120, [math.nan] * 6), (140, [math.inf] * 6), (160, [0.0] * 6), (180, []), (None, [1.0] * 6)]
    vectors += [(200, [1e300, -1e300, 0.0]), (220, [1e16, 1.0]), (240, [3e14, 2.0, 1.0, 0.5, 9.0, 0.25, 4.0]), (-20, [0.5] * 6), (40, vectors[40][1])]
    rows = [(i, v, "x") for i, v in vectors]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    usable = [(i, {t: w for t, x in enumerate(v) if (w := math.floor(64 * x))}) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = op12(spark, str(tmp_path))
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert tuples(got) == plain([x for x in usable if x[0] % 20 == 0], usable, 20)


def test_common_terms_are_added_without_scattering():
    """Terms of many slots are kept by slot, rare ones by posting, and weights beyond 2^62 always by posting; same scores."""
    rng = random.Random(5)
    rows = [{t: rng.choice([-7, -1, 2, 9]) for t in (0, 1, *rng.sample(range(2, 200), 2))} for _ in range(400)]
    ids = np.array(rng.sample(range(5000), 380) + [7001] * 20)
    ends = np.cumsum([len(r) for r in rows])
    terms, weights = (np.array([x for r in rows for x in part(r)]) for part in (list, lambda r: list(r.values())))
    query = {0: 3, 1: -4, 5: 2, 77: 1, 300: 9}
    want = {}
    for i, row in zip(ids.tolist(), rows, strict=True):
        score = sum(w * row.get(t, 0) for t, w in query.items())
        want[i] = max(want.get(i, score), score)
    for largest, kind, kept in ((4.0, np.int32, 2), (2.0**50, np.int64, 2), (2.0**63, object, 0)):
        index = exact_topk._Index(ids, ends, terms, weights.astype(float))
        index.ready(largest, len(query))
        assert index.kind is kind and sum(w is not None for w in index.whole) == kept
        got = index.scores(list(query), [float(w) for w in query.values()])
        assert dict(zip(index.distinct.tolist(), map(int, got), strict=True)) == want
