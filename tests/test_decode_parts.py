"""Transactions are parsed as far as they are read, and their payloads are built without long expressions."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import decode as D
from ledgerweave.plans.bound_decode import le_hex
from ledgerweave.session import use_utc
from ledgerweave.sources.tx_json import scan_tx

LATE = "2100-01-01"


def inbox(spark, *payloads):
    rows = [(f"t{i}", i + 1, 10, p) for i, p in enumerate(payloads)]
    found = spark.createDataFrame(rows, "tx_id string, slot bigint, block_time bigint, payload string")
    return found.withColumn("received_at", F.lit("2000-01-01").cast("timestamp"))


def payload(number, **meta):
    message = {"accountKeys": ["a", {"pubkey": "b", "signer": True}], "header": {"numRequiredSignatures": 1}, "instructions": []}
    return json.dumps({"slot": number + 1, "blockTime": 10, "transaction": {"signatures": [f"t{number}"], "message": message}, "meta": meta})


@pytest.mark.parametrize("parts", [(), ("signers",), ("calls",), ("balances",), D.PARTS])
def test_parts_give_what_the_whole_gives(spark, parts):
    balance = {"accountIndex": 0, "mint": "P1", "owner": "o", "uiTokenAmount": {"amount": "1"}}
    rows = inbox(
        spark,
        payload(0, err=None, preTokenBalances=[balance], loadedAddresses={"writable": ["w"], "readonly": []}),
        payload(1, preTokenBalances="no list"),
        payload(2, innerInstructions={"no": "list"}),
        payload(9),
        '{"slot": 5, "meta"',
        None,
    )
    late = F.lit(LATE).cast("timestamp")
    whole, narrow = scan_tx(rows, late), scan_tx(rows, late, parts)
    assert ("preTokenBalances" in narrow.schema["tx"].dataType["meta"].dataType.names) == ("balances" in parts)
    read = lambda scanned: sorted(map(repr, D.with_keys(scanned, *parts, carry=["reason"]).collect()))
    assert read(narrow) == read(whole)


def test_only_balances_read_no_movements(spark):
    rows = inbox(spark, payload(0, preTokenBalances=[]))
    held = D.positive_accounts(D.with_movements(D.with_keys(scan_tx(rows, F.lit(LATE).cast("timestamp"), ("balances",)), "balances")))
    assert "BURN_OR_SEND_TO_ZERO" not in held._jdf.queryExecution().optimizedPlan().toString()


def test_little_endian_text(spark):
    numbers = [0, 1, 255, 256, 1 << 40, (1 << 63) - 1, None]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    found = [r[0] for r in rows.select(le_hex(F.col("n"), 8)).collect()]
    assert found == [None if n is None else n.to_bytes(8, "little").hex().upper() for n in numbers]


def test_methods_are_kept_small_enough_to_be_compiled(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    assert use_utc(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_decoding_copies_a_row_at_few_places(spark):
    """Each one-row generator writes the whole row anew: one each for the document, its keys, its calls and its sales."""
    from ledgerweave.plans.live_batch import decode_batch

    decoded = decode_batch(scan_tx(inbox(spark, payload(0)), F.lit(LATE).cast("timestamp")), "hex")
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 4


def test_first_sale_of_an_asset_and_both_royalties(spark):
    """Two sales of one asset, one of another and calls of other programs between them; amounts above 2**63."""
    from ledgerweave import constants as K

    magic = K.SALE_LAYOUTS[0]
    keys = ["b", "s", "A", "B", "t", magic.program, K.SYSTEM_PROGRAM, K.ROYALTY_FIRST, K.ROYALTY_SECOND]
    le = lambda n: n.to_bytes(8, "little").hex()
    buy = lambda asset, price: {"programIdIndex": 5, "accounts": [0, 1, 4, "4", asset], "data": magic.buy_prefix + "0000" + le(price)}
    pay = lambda to, n, code="02000000": {"programIdIndex": 6, "accounts": [0, to], "data": code + le(n)}
    big = 2**63 + 5
    calls = [buy(2, 7), pay(7, big), buy(2, 9), pay(8, 1), buy(3, big), pay(7, 3), pay(7, 50, "03000000"), {"programIdIndex": 6, "accounts": [0, 7], "data": "02000000"}]
    side = lambda n: [{"accountIndex": 4, "mint": "A", "owner": "s", "uiTokenAmount": {"amount": n}}]
    meta = {"err": None, "preTokenBalances": side("18446744073709551615"), "postTokenBalances": side("0")}
    text = json.dumps({
        "slot": 1, "blockTime": 10, "meta": meta,
        "transaction": {"signatures": ["t0"], "message": {"accountKeys": keys, "instructions": calls}},
    })
    scanned = scan_tx(inbox(spark, text), F.lit(LATE).cast("timestamp"))
    sold = D.with_sales(D.with_movements(D.with_royalties(D.decode_tx(scanned, "hex"))))
    row = sold.first()
    assert [(s["asset"], int(s["price"]), s["buyer"], s["seller"]) for s in row["sales"]] == [("A", 7, "b", "s"), ("B", big, "b", "s")]
    assert (int(row["royalty"]), int(row["royalty_second"])) == (big + 3, 1)
    assert [(m["asset"], m["class"], m["from_owners"], m["to_owners"]) for m in row["movements"]] == [("A", "BURN_OR_SEND_TO_ZERO", ["s"], [])]
