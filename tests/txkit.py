"""Hand-written raw transactions with base-58 instruction data."""

import json

from ledgerweave import constants as K
from ledgerweave.functions.scalars import BASE58_ALPHABET

ME, TM, AMM = K.SALE_LAYOUTS


def encode(data: bytes) -> str:
    n, text = int.from_bytes(data, "big"), ""
    while n:
        n, d = divmod(n, 58)
        text = BASE58_ALPHABET[d] + text
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + text


def u64(n):
    return n.to_bytes(8, "little")


def call(program, accounts, data):
    return program, accounts, data


def pay(source, target, amount):
    return call(K.SYSTEM_PROGRAM, [source, target], (2).to_bytes(4, "little") + u64(amount))


def tx(ident, slot, time, signer, outer, inner=None, pre=(), post=(), err=None, shape="text"):
    """``inner`` maps a parent index to calls; ``pre`` and ``post`` are (account, asset, owner, amount)."""
    keys = [signer]

    def key(name):
        if name not in keys:
            keys.append(name)
        return keys.index(name)

    def compiled(c):
        program, accounts, data = c
        return {
            "programIdIndex": key(program),
            "accounts": [key(a) for a in accounts],
            "data": encode(data),
            "stackHeight": None,
        }

    def balance(row):
        account, asset, owner, amount = row
        return {
            "accountIndex": key(account),
            "mint": asset,
            "owner": owner,
            "programId": K.TOKEN_PROGRAMS[0],
            "uiTokenAmount": {"amount": str(amount), "decimals": 0},
        }

    instructions = [compiled(c) for c in outer]
    groups = [{"index": i, "instructions": [compiled(c) for c in cs]} for i, cs in (inner or {}).items()]
    before, after = [balance(r) for r in pre], [balance(r) for r in post]
    objects = [{"pubkey": k, "signer": k == signer} for k in keys]
    body = {
        "slot": slot,
        "blockTime": time,
        "version": 0 if shape == "text" else "legacy",
        "transaction": {
            "signatures": [ident],
            "message": {
                "header": {"numRequiredSignatures": 1},
                "accountKeys": keys if shape == "text" else objects,
                "instructions": instructions,
            },
        },
        "meta": {
            "err": err,
            "innerInstructions": groups,
            "preTokenBalances": before,
            "postTokenBalances": after,
            "loadedAddresses": {"writable": [], "readonly": []},
        },
    }
    return ident, time + 5, slot, time, json.dumps(body)


def moved(asset, source, target):
    pre = [(f"acc-{asset}-{source}", asset, source, 1), (f"acc-{asset}-{target}", asset, target, 0)]
    post = [(f"acc-{asset}-{source}", asset, source, 0), (f"acc-{asset}-{target}", asset, target, 1)]
    return {"pre": pre, "post": post}


def custody(prefix, user, wallet):
    return call(K.CUSTODY_PROGRAM, [user, "x1", "x2", wallet], bytes.fromhex(prefix) + b"\1\2")


def restart(user):
    return call(K.CUSTODY_PROGRAM, [user], bytes.fromhex(K.RESTART_PREFIX))


def burn(asset, owner):
    return call(K.TOKEN_PROGRAMS[0], [f"acc-{asset}-{owner}", asset, owner], bytes([8]) + u64(1))


def single_sale(asset, buyer, seller, price):
    accounts = [buyer, seller, "x3", "x4", asset]
    return call(ME.program, accounts, bytes.fromhex(ME.buy_prefix) + b"\0\0" + u64(price))


def paired_sale(layout, asset, buyer, seller, price):
    accounts = [f"pad{i}" for i in range(layout.asset)]
    accounts[layout.buyer - 1], accounts[layout.asset - 1] = buyer, asset
    accounts += [f"pad{i}" for i in range(len(accounts), layout.seller)]
    accounts[layout.seller - 1] = seller
    gap = layout.price_at - 1 - 8
    return (
        call(layout.program, accounts, bytes.fromhex(layout.buy_prefix)),
        call(layout.program, [buyer], bytes.fromhex(layout.event_prefix) + bytes(gap) + u64(price)),
    )
