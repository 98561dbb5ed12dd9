"""Scalar and ordered helpers against plain Python."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerweave.functions import scalars as P
from ledgerweave.functions.fingerprint import fingerprint
from ledgerweave.functions.ordered import dense_index, exclusive_prefix, keep_first, keep_last


def base58(text):
    n = 0
    for c in text:
        n = n * 58 + P.BASE58_ALPHABET.index(c)
    body = n.to_bytes((n.bit_length() + 7) // 8, "big") if n else b""
    return b"\0" * (len(text) - len(text.lstrip("1"))) + body


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(alphabet=P.BASE58_ALPHABET, max_size=100), min_size=20, max_size=60))
def test_base58(texts):
    from ledgerweave.session import local_session

    spark = local_session(partitions=4, app="tests")
    df = spark.createDataFrame([(t,) for t in [*texts, "1112", ""]], "t string")
    for row in df.select("t", P.base58_to_binary(F.col("t")).alias("b")).collect():
        assert bytes(row["b"]) == base58(row["t"])


def test_base58_rejects_foreign_characters(spark):
    df = spark.createDataFrame([("0",), ("abcO",), ("ab l",)], "t string")
    assert [r[0] for r in df.select(P.base58_to_binary(F.col("t"))).collect()] == [None] * 3


def test_addresses(spark):
    good = "8VAHrpJ9nsqRLaujbzpuCxhAhjsE8wA4ZvUHwx2VZw3y"
    texts = [good, "1" * 32, "1" * 31, good[:-1] + "0", "z" * 45, "z" * 44]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [32 <= len(t) <= 44 and set(t) <= set(P.BASE58_ALPHABET) and len(base58(t)) == 32 for t in texts]
    assert [r[0] for r in df.select(P.address_ok(F.col("t"))).collect()] == want


def test_rounding_matches_binary_half_even(spark):
    rng = random.Random(1)
    xs = [0.25, 2.675, 1.005, 0.05, 0.15, 0.35, 0.45, 99.95, 0.0, 100.0, 12.25]
    xs += [100.0 * rng.randint(0, 999) / rng.randint(1, 999) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (1, 2):
        rows = df.select("x", P.round_half_even(F.col("x"), digits).alias("y")).collect()
        assert [r["y"] for r in rows] == [round(r["x"], digits) for r in rows]


def test_little_endian_fields(spark):
    data = bytes([2, 0, 0, 0]) + (2**64 - 1).to_bytes(8, "little")
    row = (
        spark.createDataFrame([(data,)], "b binary")
        .select(P.uint_le(F.col("b"), 1, 4), P.uint_le(F.col("b"), 5, 8), P.uint_le(F.col("b"), 6, 8))
        .first()
    )
    assert (int(row[0]), int(row[1]), row[2]) == (2, 2**64 - 1, None)


def test_trimmed_number(spark):
    df = spark.createDataFrame([("0.070000000",), ("1.5",), ("0",), ("120",), ("123.000000001",)], "x string")
    got = [r[0] for r in df.select(P.trimmed_number(F.col("x").cast("decimal(38,9)"))).collect()]
    assert got == ["0.07", "1.5", "0", "120", "123.000000001"]


def test_prefix_walk_is_independent_of_chunks(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), i, rng.randint(0, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    want, total, best = {}, {}, {}
    for k, i, v in rows:
        want[i] = (total.get(k, 0), best.get(k))
        total[k] = total.get(k, 0) + v
        best[k] = max(best.get(k, -1), v)
    for size in (1, 13, 1000):
        got = exclusive_prefix(
            df, ["k"], ["i"], F.expr(f"i div {size}"), sums={"s": F.col("v")}, maxima={"m": F.col("v")}
        ).collect()
        assert {r["i"]: (r["s"], r["m"]) for r in got} == want


def test_dense_index_and_keeps(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g bigint, i bigint").repartition(7)
    got = {(r["g"], r["i"]): r["idx"] for r in dense_index(df, ["g", "i"]).collect()}
    assert got == {pair: n for n, pair in enumerate(sorted(rows))}
    first = {r["g"]: r["i"] for r in keep_first(df, ["g"], ["i"]).collect()}
    last = {r["g"]: r["i"] for r in keep_last(df, ["g"], ["i"]).collect()}
    assert first == {g: min(i for h, i in rows if h == g) for g, _ in rows}
    assert last == {g: max(i for h, i in rows if h == g) for g, _ in rows}


def test_fingerprint_ignores_order_and_sees_copies(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    one = fingerprint(df, ["id", "v"]).first()["content_hash"]
    assert fingerprint(df.repartition(5).orderBy(F.desc("id")), ["id", "v"]).first()["content_hash"] == one
    assert fingerprint(df.unionByName(df.limit(1)), ["id", "v"]).first()["content_hash"] != one
