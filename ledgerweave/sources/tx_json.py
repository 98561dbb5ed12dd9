"""Raw transaction JSON: schema, parsing and row-level validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.stage import stage

INSTRUCTION = "struct<programId:string,programIdIndex:int,accounts:array<string>,data:string>"
BALANCE = "struct<accountIndex:int,mint:string,owner:string,uiTokenAmount:struct<amount:string>>"
# Keys and signatures arrive as text or as objects; an object is kept as its JSON text.
TX_SCHEMA = f"""
    slot bigint, blockTime bigint, version string,
    signature string, transactionSignature string, txSignature string,
    transaction struct<
        signature:string,
        signatures:array<string>,
        message:struct<header:struct<numRequiredSignatures:int>,
                       accountKeys:array<string>,
                       instructions:array<{INSTRUCTION}>>>,
    meta struct<
        err:string,
        innerInstructions:array<struct<index:int,instructions:array<{INSTRUCTION}>>>,
        preTokenBalances:array<{BALANCE}>,
        postTokenBalances:array<{BALANCE}>,
        loadedAddresses:struct<writable:array<string>,readonly:array<string>>>,
    _broken string
"""


def parse_tx(payload: Column, schema: str = TX_SCHEMA) -> Column:
    """Payload text to a nested transaction; unreadable text is kept in ``_broken``."""
    return F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})


def parts_schema(parts: Sequence[str]) -> str:
    """The fields that time, success and account keys need, and those of the named ``parts`` (see ``decode.with_keys``)."""
    message, meta = ["accountKeys:array<string>"], ["err:string", "loadedAddresses:struct<writable:array<string>,readonly:array<string>>"]
    if "signers" in parts:
        message.append("header:struct<numRequiredSignatures:int>")
    if "calls" in parts:
        message.append(f"instructions:array<{INSTRUCTION}>")
        meta.append(f"innerInstructions:array<struct<index:int,instructions:array<{INSTRUCTION}>>>")
    if "balances" in parts:
        meta += [f"preTokenBalances:array<{BALANCE}>", f"postTokenBalances:array<{BALANCE}>"]
    return (
        f"slot bigint, blockTime bigint, transaction struct<message:struct<{','.join(message)}>>, meta struct<{','.join(meta)}>, _broken string"
    )


def object_field(text: Column, field: str) -> Column:
    """A field of a JSON object, or NULL for plain text."""
    return F.when(text.startswith("{"), F.get_json_object(text, f"$.{field}"))


def first_signature(tx: Column) -> Column:
    head = F.get(tx["transaction"]["signatures"], 0)
    return F.coalesce(object_field(head, "signature"), object_field(head, "sig"), head)


def payload_id(tx: Column, shortest: int) -> Column:
    """Transaction id of a pushed payload: the direct fields first, then the first signature."""
    direct = [tx["signature"], tx["transactionSignature"], tx["txSignature"], tx["transaction"]["signature"]]
    usable = lambda c: F.when(F.length(c) > shortest, c)
    return F.coalesce(*[usable(c) for c in direct], usable(first_signature(tx)))


def payload_rows(bodies: DataFrame, body: str, shortest: int = 20) -> DataFrame:
    """Pushed bodies, one object or an array of them, to one row per transaction with a usable id."""
    text = F.trim(body)
    many = F.from_json(text, "array<string>")
    each = F.when(text.startswith("["), many).otherwise(F.array(text))
    rows = stage(bodies.select("*", F.posexplode(each).alias("pos", "payload")), {"tx": parse_tx(F.col("payload"))})
    ident = payload_id(F.col("tx"), shortest)
    return (
        rows.withColumns({"tx_id": ident, "slot": F.col("tx.slot"), "block_time": F.col("tx.blockTime")})
        .filter(F.col("tx_id").isNotNull())
        .drop("tx", body)
    )


def scan_tx(inbox: DataFrame, snapshot: Column, parts: Sequence[str] | None = None) -> DataFrame:
    """Parse inbox payloads and say why a row cannot be used; ``reason`` is NULL for a good row.

    Inbox rows: tx_id, received_at, slot, block_time, payload. With ``parts``, ``tx`` holds no other fields than those; the
    ``reason`` is still that of the whole payload, and is only computed where it is read.
    """
    tx = F.col("tx") if parts is None else parse_tx(F.col("payload"))
    own = F.col("tx.slot")
    slot = F.coalesce(F.when(own != 0, own), F.col("slot"), F.lit(0))
    reason = (
        F.when(F.col("payload").isNull(), "payload is not text")
        .when(~F.ltrim("payload").startswith("{") | tx["_broken"].isNotNull(), "payload is not an object")
        .when(first_signature(tx).isNull(), "no signature")
        .when(first_signature(tx) != F.col("tx_id"), "signature mismatch")
        .when(slot <= 0, "invalid slot")
        .when(tx["blockTime"].isNull(), "missing block time")
        .when(F.col("block_time").isNotNull() & (F.col("block_time") != tx["blockTime"]), "block time mismatch")
        .when(F.col("received_at").isNull() | (F.col("received_at") > snapshot), "outside snapshot")
    )
    parsed = stage(inbox, {"tx": parse_tx(F.col("payload"), TX_SCHEMA if parts is None else parts_schema(parts))})
    return parsed.withColumns({"seq": slot, "reason": reason})
