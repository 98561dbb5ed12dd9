"""Periodic runs against all periods of all stretches, and the operator on unusual rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerweave.llm import periodic
from ledgerweave.llm.queries import op11

CLASH = ", _text string, runs string, best string, a string, n string, h string, words string"


def plain_runs(words):
    """Every lag, every stretch of equal words at that lag; of equal stretches the smallest lag is the period."""
    least = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        start = None
        for i in range(q, n + 1):
            if i < n and words[i] == words[i - q]:
                start = i if start is None else start
            elif start is not None:
                stretch = (start - q, i - start + q)
                if stretch[1] >= max(6, 4 * q):
                    least.setdefault(stretch, q)
                start = None
    return sorted((s, n, q) for (s, n), q in least.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_short_texts_over_few_words():
    rng = random.Random(3)
    texts = []
    for _ in range(3000):
        letters = "ab" if rng.random() < 0.5 else "abc"
        parts = [[rng.choice(letters) for _ in range(rng.randint(1, 7))] * rng.randint(1, 7) for _ in range(rng.randint(1, 4))]
        texts.append([x for p in parts for x in p])
    judged = periodic._judged([[w.encode() for w in t] for t in texts])
    seen = Counter()
    for words, (runs, collapsed) in zip(texts, judged, strict=True):
        expected = plain_runs(words)
        assert runs == expected
        assert collapsed.decode() == plain_collapsed(words, expected)
        seen.update(q for *_, q in expected)
    assert len(seen) >= 6  # several sizes of the DP took part


def test_long_texts_cost_no_more_for_repeats():
    """One word for ever, and a long period: few cells, one run."""
    n = 300_000
    assert periodic.diagonal_runs(np.zeros(n, np.int64), n) == [(0, n, 1)]
    assert periodic.diagonal_runs(np.tile(np.arange(50_000), 5)[:-7], n) == [(0, 249_993, 50_000)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    body = [rng.choice(["x", "y", "zé", "漢"]) for _ in range(40)]
    long = [str(i) for i in range(3000)]
    return [
        (1, " ".join(body)), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "a b c d e"), (7, "a a a a a"), (8, "a\na\ta a  a a"), (9, "a b " * 4),
        (10, "a a a a a a b b b b b b"), (11, " ".join(long * 4 + ["end"])), (12, "w " * 9000), (12, "w " * 9000), (None, "a b " * 5), (-7, "p q r " * 9),
        (13, "  " * 8), (14, "x y x y x y x y x z x y x y x y x y"),
    ]


def test_rows(spark, rows):
    docs = spark.createDataFrame([(*r, *["z"] * CLASH.count("string")) for r in rows], "doc_id long, text string" + CLASH).repartition(3)
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.find_runs(docs, ["doc_id"]).collect())
    expected = Counter()
    for doc_id, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        # Words repeated thousands of times have one run; all lags of them would take too long here.
        runs = plain_runs(words) if len(words) < 8000 else [(0, len(words) - (words[-1] == "end"), 1 if words[0] == "w" else 3000)]
        expected[doc_id, tuple(runs), plain_collapsed(words, runs)] += 1
    assert got == expected
    assert periodic.find_runs(docs.limit(0), ["doc_id"]).isEmpty()


def test_query_over_plain_rows(spark, rows, tmp_path):
    import zlib

    rows = [*rows, *((i, f"{i} start " + " ".join(f"t{j % (i % 9 + 3)}" for j in range(60))) for i in range(100, 220))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected, planted = Counter(), 0
    for doc_id, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        n = len(words)
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and n:
            g = zlib.crc32(str(doc_id).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain_runs(words) if n < 8000 else [(0, n - (words[-1] == "end"), 1 if words[0] == "w" else 3000)]
        best = (None,) * 4
        for s, length, q in runs:
            if best[0] is None or length * best[2] > best[1] * q:
                best = (s, length, q, 1000 * length // q)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), plain_collapsed(words, runs))]
        expected[(doc_id, len(runs), *best, *digest)] += 1
    assert planted > 5
    assert Counter(map(tuple, op11(spark, str(tmp_path)).collect())) == expected
