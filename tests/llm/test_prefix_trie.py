"""Prefix trie against a plain trie, and subtree sums over forests of many shapes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerweave.llm import forest
from ledgerweave.llm.queries import op13


def parents(shape, n, rng):
    if shape == "chain":
        return [i - 1 for i in range(n)]
    if shape == "star":
        return [-1] + [0] * (n - 1)
    if shape == "broom":
        return [i - 1 if i < n // 2 else n // 2 - 1 for i in range(n)]
    if shape == "caterpillar":
        return [-1, *[i - 1 if i % 2 else i - 2 if i > 1 else 0 for i in range(1, n)]]
    if shape == "forest":
        return [-1 if rng.random() < 0.2 else rng.randrange(i) if i else -1 for i in range(n)]
    return [-1, *[rng.randrange(max(0, i - 4), i) for i in range(1, n)]]


def plain_sums(parent, values):
    out = [list(v) for v in values]
    for v in reversed(range(len(parent))):
        if parent[v] >= 0:
            out[parent[v]] = [a + b for a, b in zip(out[parent[v]], out[v], strict=True)]
    return out


SHAPES = ["chain", "star", "broom", "caterpillar", "forest", "deep"]


@pytest.mark.parametrize("shape", SHAPES)
def test_centroid_sums(shape):
    rng = random.Random(shape)
    for n in (1, 2, 3, 7, 100, 900):
        parent = parents(shape, n, rng)
        values = [[rng.randint(-9, 9), 10**15 + i] for i in range(n)]
        mixed = list(range(n))
        rng.shuffle(mixed)  # places need no order
        where = {v: i for i, v in enumerate(mixed)}
        got = forest.centroid_sums(np.array([where[parent[v]] if parent[v] >= 0 else -1 for v in mixed]), np.array([values[v] for v in mixed]))
        expected = plain_sums(parent, values)
        assert got.tolist() == [expected[v] for v in mixed]


@pytest.mark.parametrize("shape", SHAPES)
def test_rollup_in_pieces(spark, shape):
    """Pieces of seven nodes: several rounds of paths, trees under them, and tops without a parent."""
    n, rng = 260, random.Random(shape)
    parent = parents(shape, n, rng)
    values = [[rng.randint(0, 9), 1] for _ in range(n)]
    sums = plain_sums(parent, values)
    rows = [(i, parent[i] if parent[i] >= 0 else None, sums[i][1], values[i][0], "z") for i in range(n)]
    nodes = spark.createDataFrame(rows, "node long, parent long, size long, x long, top string").repartition(3)
    got = {r.node: r.x for r in forest.rollup(nodes, ["x"], piece=7).collect()}
    assert got == {i: sums[i][0] for i in range(n)}


def test_rollup_of_nothing(spark):
    assert forest.rollup(spark.createDataFrame([], "node long, parent long, size long, x long"), ["x"]).isEmpty()


def test_join_one(spark, monkeypatch):
    monkeypatch.setattr(forest, "HOT", 4)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 30 + [3, 4, None])], "k long, i long")
    table = spark.createDataFrame([(1, "a"), (3, "c"), (9, "z")], "k long, v string")
    expected = Counter((k, i, {1: "a", 3: "c"}.get(k)) for k, i in ((r.k, r.i) for r in rows.collect()))
    assert Counter(map(tuple, forest.join_one(rows, table, "k").select("k", "i", "v").collect())) == expected


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in turns.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = [*own.get(c - int(np.fmod(c, 100)), [])[:h], *x[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own_members in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(own_members) - 1) * len(p[-1][1]) if p else 0
    out = Counter()
    for p, m in members.items():
        listed = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out[m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], listed] += 1
    return out


@pytest.mark.parametrize("piece", [1 << 16, 5])
def test_query(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(forest, "PIECE", piece)
    monkeypatch.setattr(forest, "HOT", 20)
    rng = random.Random(8)
    rows = []
    for c in [*range(-3, 60), *range(100, 130), *range(505, 512), 700, 10**15]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "漢字 é"])) for t in range(rng.randint(1, 7))]
    rows += [(800, 0, None, None), (800, None, None, "first"), (800, None, "user", None), (801, 1, "user", "tie"), (801, 1, "user", "tie"), (801, 1, "bot", "tie")]
    rows += [(900, t, "user", "long " * (t % 3)) for t in range(1500 if piece > 5 else 90)]  # one conversation with most of the turns
    rows += [(c, t, "user", "copy") for c in range(1000, 1099) for t in range(3)]  # copies
    rows += [(None, 1, "user", "no conversation"), (1200, 3, "user", "x" * 100_000)]
    table = [(*r, "z", "z") for r in rows]
    rng.shuffle(table)
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string, node string, pos string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op13(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert op13(spark, str(tmp_path)).isEmpty()
