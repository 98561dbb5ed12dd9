"""Decode jobs: nested transactions to accounts, signers, calls, movements and sales.

Everything a transaction yields is computed from its own row with array functions, so decoding is
one scan without a shuffle. Only the check against the table of known assets is a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave import constants as K
from ledgerweave.functions.scalars import base58_to_binary, iso_z, starts_with_hex, uint_le
from ledgerweave.functions.stage import once, stage
from ledgerweave.operators.custody import LOCK, RECEIVED, RESTART, SENT, TRANSFER, UNLOCK
from ledgerweave.sources.tx_json import first_signature, object_field


def _or_empty(col: Column, kind: str) -> Column:
    return F.coalesce(col, F.array().cast(kind))


def _joined(*arrays: Column) -> Column:
    """``concat`` of arrays, which outside generated code costs several times as much."""
    return F.flatten(F.array(*arrays))


def _raw_keys(tx: Column) -> Column:
    return _or_empty(tx["transaction"]["message"]["accountKeys"], "array<string>")


def _names(keys: Column) -> Column:
    return F.transform(
        keys, lambda k: F.when(k.startswith("{"), F.coalesce(object_field(k, "pubkey"), F.lit(""))).otherwise(k)
    )


def static_keys(tx: Column) -> Column:
    return _names(_raw_keys(tx))


def account_keys(tx: Column) -> Column:
    """Static keys, then loaded writable, then loaded read-only ones."""
    loaded = tx["meta"]["loadedAddresses"]
    return _joined(
        static_keys(tx), _or_empty(loaded["writable"], "array<string>"), _or_empty(loaded["readonly"], "array<string>")
    )


def signers(tx: Column) -> Column:
    """Keys flagged as signers, else as many leading static keys as the header requires."""
    keys = _raw_keys(tx)
    flagged = F.filter(
        F.transform(keys, lambda k: F.when(object_field(k, "signer") == "true", object_field(k, "pubkey"))),
        lambda k: k.isNotNull() & (k != ""),
    )
    required = F.coalesce(tx["transaction"]["message"]["header"]["numRequiredSignatures"], F.lit(0))
    return F.when(F.size(flagged) > 0, flagged).otherwise(_names(F.slice(keys, F.lit(1), required)))


def _resolve(inst: Column, outer: Column, keys: Column, decode, programs: Sequence[str] | None) -> Column:
    program = F.coalesce(inst["programId"], F.get(keys, inst["programIdIndex"]))
    accounts = F.filter(
        F.transform(
            _or_empty(inst["accounts"], "array<string>"),
            # An address is far too long to read as an integer. Most are indexes, and those are read once.
            lambda a: F.coalesce(F.get(keys, a.try_cast("int")), F.when(a.try_cast("int").isNull(), a)),
        ),
        lambda a: a.isNotNull(),
    )
    data = decode(inst["data"]) if programs is None else F.when(program.isin(list(programs)), decode(inst["data"]))
    return F.struct(
        outer.cast("bigint").alias("outer"),
        program.alias("program"),
        accounts.alias("accounts"),
        data.alias("data"),
        inst["data"].alias("text"),
    )


PARTS = ("signers", "calls", "balances")


def with_keys(scanned: DataFrame, *parts: str, carry: Sequence[str] = ()) -> DataFrame:
    """Time, success and account keys of scanned transactions, and the raw ``parts`` that are read later.

    Parts: ``signers``, ``calls`` (raw outer and inner instructions) and ``balances``. A part that is not named is not
    parsed: the one-row generator behind ``stage`` would otherwise keep it alive. Columns to ``carry`` stay as they are.
    """
    tx = F.col("tx")
    inst, groups = f"array<{_INST}>", f"array<struct<index:int,instructions:array<{_INST}>>>"
    columns = {"ts": F.timestamp_seconds(tx["blockTime"]), "ok": tx["meta"]["err"].isNull(), "keys": account_keys(tx)}
    if "signers" in parts:
        columns["signers"] = signers(tx)
    if "calls" in parts:
        columns["_outer"] = _or_empty(tx["transaction"]["message"]["instructions"], inst)
        columns["_inner"] = _or_empty(tx["meta"]["innerInstructions"], groups)
    if "balances" in parts:
        columns |= {"pre": tx["meta"]["preTokenBalances"], "post": tx["meta"]["postTokenBalances"]}
    return stage(scanned.select("tx_id", "seq", "tx", *carry), columns, keep=["tx_id", "seq", *carry])


def decode_tx(
    scanned: DataFrame,
    encoding: str = "base58",
    programs: Sequence[str] | None = None,
    carry: Sequence[str] = (),
    parts: Sequence[str] = PARTS,
) -> DataFrame:
    """Add keys, signers and calls to scanned transactions.

    ``calls`` holds outer instructions, then inner ones under the index of their parent. A call
    whose program index is out of range is dropped, and so is an account whose index is.
    ``programs`` limits data decoding to the programs that are read later, and ``parts``, with the
    calls among them, what is taken from the transactions.
    """
    return with_calls(with_keys(scanned, *parts, carry=carry), encoding, programs)


def with_calls(staged: DataFrame, encoding: str = "base58", programs: Sequence[str] | None = None) -> DataFrame:
    """Resolve the raw instructions of ``with_keys(..., "calls")``."""
    decode = {"base58": base58_to_binary, "hex": F.unhex}[encoding]
    keys = F.col("keys")
    outer = F.transform("_outer", lambda inst, i: _resolve(inst, i, keys, decode, programs))
    inner = F.flatten(
        F.transform(
            F.filter("_inner", lambda g: g["index"].isNotNull()),
            lambda g: F.transform(
                _or_empty(g["instructions"], f"array<{_INST}>"),
                lambda inst: _resolve(inst, g["index"], keys, decode, programs),
            ),
        )
    )
    kept = F.filter(_joined(outer, inner), lambda c: c["program"].isNotNull() & c["text"].isNotNull())
    called = stage(staged, {"calls": kept}, keep=[c for c in staged.columns if c not in ("_outer", "_inner")])
    return called.withColumn("undecodable", _undecodable(programs))


_INST = "struct<programId:string,programIdIndex:int,accounts:array<string>,data:string>"


def _undecodable(programs: Sequence[str] | None) -> Column:
    """Does any call that should have been decoded hold a foreign character?"""
    wanted = (lambda c: F.lit(True)) if programs is None else (lambda c: c["program"].isin(list(programs)))
    return F.exists("calls", lambda c: c["data"].isNull() & wanted(c))


def call_rows(decoded: DataFrame) -> DataFrame:
    """One row per call in transaction order."""
    return decoded.select("tx_id", "seq", "ts", "ok", F.posexplode("calls").alias("pos", "_c")).select(
        "tx_id",
        "seq",
        "ts",
        "ok",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("_c.outer"),
        F.col("_c.program"),
        F.col("_c.accounts"),
        F.col("_c.data"),
    )


def custody_array(distinct: bool = True) -> Column:
    """Lock, unlock and restart calls by program and data prefix, acting for the first signer.

    Lock and unlock name their wallet in a fixed argument and are ignored without it, and nothing
    counts without a signer. With ``distinct`` equal calls collapse to the first.
    """
    actor = F.get("signers", 0)

    def classify(c: Column) -> Column:
        action = (
            F.when(starts_with_hex(c["data"], K.LOCK_PREFIX), LOCK)
            .when(starts_with_hex(c["data"], K.UNLOCK_PREFIX), UNLOCK)
            .when(starts_with_hex(c["data"], K.RESTART_PREFIX), RESTART)
        )
        wallet = F.when(action != RESTART, F.get(c["accounts"], K.CUSTODY_WALLET_ARGUMENT - 1))
        return F.struct(action.alias("action"), actor.alias("caller"), wallet.alias("wallet"))

    ours = F.transform(F.filter("calls", lambda c: c["program"] == K.CUSTODY_PROGRAM), classify)
    valid = F.filter(
        ours,
        lambda w: w["action"].isNotNull()
        & F.coalesce(w["caller"] != "", F.lit(False))
        & ((w["action"] == RESTART) | w["wallet"].isNotNull()),
    )
    return F.array_distinct(valid) if distinct else valid


def custody_calls(decoded: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per custody call."""
    return decoded.select(
        F.col("tx_id").alias("tx"), "seq", "ts", "ok", F.posexplode(custody_array(distinct)).alias("pos", "_w")
    ).select("tx", "seq", "ts", "ok", "pos", "_w.action", "_w.caller", "_w.wallet")


def _balances(rows: Column, keys: Column) -> Column:
    """Usable balance rows with their account; an unreadable amount counts as zero."""
    shaped = F.transform(
        _or_empty(rows, "array<struct<accountIndex:int,mint:string,owner:string,uiTokenAmount:struct<amount:string>>>"),
        lambda b: F.struct(
            b["mint"].alias("asset"),
            F.get(keys, b["accountIndex"]).alias("account"),
            F.when(b["owner"] != "", b["owner"]).alias("owner"),
            F.coalesce(b["uiTokenAmount"]["amount"].try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("amount"),
        ),
    )
    return F.filter(shaped, lambda b: b["asset"].isNotNull() & (b["asset"] != "") & b["account"].isNotNull())


def movement_array(pre: Column, post: Column) -> Column:
    """Owner movements of one transaction from its balances before and after.

    ``pre`` and ``post`` are prepared balance arrays, each computed once; a later row of an account replaces an
    earlier one.
    """
    return once(F.struct(pre.alias("pre"), post.alias("post")), lambda sides: _movements(sides["pre"], sides["post"]))


def _movements(pre: Column, post: Column) -> Column:
    zero = F.lit(0).cast("decimal(20,0)")
    assets = F.sort_array(F.array_distinct(F.transform(_joined(pre, post), lambda b: b["asset"])))

    def of_asset(asset: Column) -> Column:
        mine = lambda side: F.filter(side, lambda b: b["asset"] == asset)

        def changed(own: Column) -> Column:
            accounts = F.array_distinct(F.transform(_joined(own["pre"], own["post"]), lambda b: b["account"]))

            def change(account: Column) -> Column:
                last = lambda side: F.try_element_at(
                    F.filter(own[side], lambda b: b["account"] == account), F.lit(-1)
                )

                def compare(p: Column) -> Column:
                    was, now = F.coalesce(p["before"]["amount"], zero), F.coalesce(p["after"]["amount"], zero)
                    return F.struct(
                        F.signum(now - was).alias("sign"), p["before"]["owner"].alias("was"), p["after"]["owner"].alias("becomes")
                    )

                return once(F.struct(last("pre").alias("before"), last("post").alias("after")), compare)

            return F.filter(F.transform(accounts, change), lambda c: c["sign"] != 0)

        changes = once(F.struct(mine(pre).alias("pre"), mine(post).alias("post")), changed)
        return F.struct(asset.alias("asset"), changes.alias("changes"))

    def owners(changes: Column, sign: int, field: str) -> Column:
        names = F.transform(F.filter(changes, lambda c: c["sign"] == sign), lambda c: c[field])
        return F.sort_array(F.array_distinct(F.filter(names, lambda n: n.isNotNull())))

    def finish(m: Column) -> Column:
        sent = F.exists(m["changes"], lambda c: c["sign"] < 0)
        got = F.exists(m["changes"], lambda c: c["sign"] > 0)
        return F.struct(
            m["asset"].alias("asset"),
            F.when(sent & got, TRANSFER).when(sent, SENT).when(got, RECEIVED).alias("class"),
            owners(m["changes"], -1, "was").alias("from_owners"),
            owners(m["changes"], 1, "becomes").alias("to_owners"),
        )

    return F.filter(F.transform(F.transform(assets, of_asset), finish), lambda m: m["class"].isNotNull())


def with_movements(decoded: DataFrame) -> DataFrame:
    """Usable balances, and the movements between them. Only what is read later is computed, the movements in one go."""
    pre, post = [_balances(F.col(side), F.col("keys")) for side in ("pre", "post")]
    return decoded.withColumns({"pre": pre, "post": post, "movements": movement_array(pre, post)})


def burn_named(calls: Column, asset: Column) -> Column:
    """Is there an explicit burn instruction for the asset?"""
    return F.exists(
        calls,
        lambda c: c["program"].isin(K.TOKEN_PROGRAMS)
        & F.hex(F.substring(c["data"], 1, 1)).isin(K.BURN_BYTES)
        & F.coalesce(F.get(c["accounts"], K.BURN_ASSET_ARGUMENT - 1) == asset, F.lit(False)),
    )


def calls_read_later(sold: DataFrame) -> DataFrame:
    """Once royalties, sales and ``undecodable`` are there, only custody calls and burns are read: ``calls`` without the others.

    A token call without data may be a burn, so it stays.
    """
    burns = lambda c: c["program"].isin(K.TOKEN_PROGRAMS) & (
        c["data"].isNull() | F.hex(F.substring(c["data"], 1, 1)).isin(K.BURN_BYTES)
    )
    return sold.withColumn("calls", F.filter("calls", lambda c: (c["program"] == K.CUSTODY_PROGRAM) | burns(c)))


def movement_rows(moved: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """One row per movement of a known asset; an owner is set only where it is the only one.

    ``burn_ok`` is there if the transactions carry their calls.
    """
    only = lambda c: F.when(F.size(c) == 1, F.get(c, 0))
    called = "calls" in moved.columns
    calls = ["calls"] if called else []
    rows = moved.select("tx_id", "seq", "ts", "ok", *calls, F.explode("movements").alias("_m")).select(
        F.col("tx_id").alias("tx"),
        "seq",
        "ts",
        "ok",
        F.col("_m.asset"),
        F.col("_m.class"),
        only(F.col("_m.from_owners")).alias("from_owner"),
        only(F.col("_m.to_owners")).alias("to_owner"),
        F.col("_m.from_owners"),
        F.col("_m.to_owners"),
        *([burn_named(F.col("calls"), F.col("_m.asset")).alias("burn_ok")] if called else []),
    )
    return rows if assets is None else rows.join(assets.select("asset"), "asset", "left_semi")


def positive_accounts(moved: DataFrame) -> DataFrame:
    """Accounts that hold exactly one unit of an asset before and after each transaction."""
    rows = moved.select(
        "tx_id",
        "seq",
        "ts",
        "ok",
        F.explode(F.array_distinct(F.transform(F.concat("pre", "post"), lambda b: b["asset"]))).alias("asset"),
        "pre",
        "post",
    )
    one = F.lit(1).cast("decimal(20,0)")

    def holders(side: str) -> Column:
        mine = F.filter(side, lambda b: (b["asset"] == F.col("asset")) & (b["amount"] == one))
        return F.array_distinct(F.transform(mine, lambda b: b["account"]))

    held = rows.select("tx_id", "seq", "ts", "ok", "asset", holders("pre").alias("_b"), holders("post").alias("_a"))
    return held.filter((F.size("_b") > 0) | (F.size("_a") > 0)).select(
        F.col("tx_id").alias("tx"),
        "seq",
        "ts",
        "ok",
        "asset",
        F.get("_b", 0).alias("before"),
        F.get("_a", 0).alias("after"),
        ((F.size("_b") > 1) | (F.size("_a") > 1)).alias("ambiguous"),
    )


def royalty(calls: Column, recipient: str) -> Column:
    """Units sent to one royalty recipient by system transfers anywhere in the transaction."""

    code = K.TRANSFER_CODE.to_bytes(4, "little").hex()

    def pays(c: Column) -> Column:
        return (
            (c["program"] == K.SYSTEM_PROGRAM)
            & (F.get(c["accounts"], K.TRANSFER_RECIPIENT_ARGUMENT - 1) == recipient)
            & starts_with_hex(c["data"], code)
        )

    # The few payments are found first: decimals are slow to read and to add.
    amounts = F.transform(F.filter(calls, pays), lambda c: uint_le(c["data"], K.TRANSFER_AMOUNT_AT, 8))
    return F.aggregate(
        amounts, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + F.coalesce(x, F.lit(0))).cast("decimal(38,0)")
    )


def with_royalties(decoded: DataFrame) -> DataFrame:
    firsts = {"royalty": K.ROYALTY_FIRST, "royalty_second": K.ROYALTY_SECOND}
    return decoded.withColumns({name: royalty(F.col("calls"), recipient) for name, recipient in firsts.items()})


def _sale(layout: K.SaleLayout, buy: Column, priced: Column) -> Column:
    """Sale struct of a layout, NULL unless asset, buyer, seller and price are all there."""
    argument = lambda n: F.get(buy["accounts"], n - 1)
    parts = F.struct(
        argument(layout.asset).alias("asset"),
        argument(layout.buyer).alias("buyer"),
        argument(layout.seller).alias("seller"),
        uint_le(priced["data"], layout.price_at, 8).alias("price"),
        F.lit(layout.market).alias("market"),
        F.lit(layout.detail).alias("detail"),
        F.lit(layout.method).alias("method"),
    )
    whole = lambda p: (p["asset"] != "") & (p["buyer"] != "") & (p["seller"] != "") & p["price"].isNotNull()
    return once(parts, lambda p: F.when(F.coalesce(whole(p), F.lit(False)), p))


def sale_of_group(calls: Column, layouts: Sequence[K.SaleLayout]) -> Column:
    """Sale of the calls under one outer instruction, by the first layout that is complete."""

    def by_layout(layout: K.SaleLayout) -> Column:
        own = lambda c: c["program"] == layout.program
        ours = lambda prefix: F.filter(calls, lambda c: own(c) & starts_with_hex(c["data"], prefix))
        if layout.event_prefix is None:
            every = F.transform(ours(layout.buy_prefix), lambda c: _sale(layout, c, c))
            found = F.get(F.filter(every, lambda s: s.isNotNull()), 0)
        else:
            pair = F.struct(F.get(ours(layout.buy_prefix), 0).alias("buy"), F.get(ours(layout.event_prefix), 0).alias("event"))
            whole = lambda p: p["buy"].isNotNull() & p["event"].isNotNull()
            found = once(pair, lambda p: F.when(whole(p), _sale(layout, p["buy"], p["event"])))
        return F.when(F.exists(calls, own), found)

    return F.coalesce(*[by_layout(x) for x in layouts])


def with_sales(decoded: DataFrame, layouts: Sequence[K.SaleLayout] = tuple(K.SALE_LAYOUTS)) -> DataFrame:
    """Add the sales of each successful transaction: the first per asset in group order."""
    programs = [x.program for x in layouts]

    def every(ours: Column) -> Column:
        groups = F.array_distinct(F.transform(ours, lambda c: c["outer"]))
        found = F.transform(groups, lambda g: once(F.filter(ours, lambda c: c["outer"] == g), lambda cs: sale_of_group(cs, layouts)))
        return F.filter(found, lambda s: s.isNotNull())

    def firsts(sales: Column) -> Column:
        names = F.array_distinct(F.transform(sales, lambda s: s["asset"]))
        each = F.transform(names, lambda a: F.get(F.filter(sales, lambda s: s["asset"] == a), 0))
        return F.when(F.size(sales) < 2, sales).otherwise(each)

    # Calls of other programs are in no sale, so the groups are searched without them.
    ours = F.filter("calls", lambda c: c["program"].isin(programs))
    return stage(decoded, {"sales": F.when(F.col("ok"), once(ours, lambda cs: once(every(cs), firsts)))})


def sale_rows(sold: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """One row per sale of a known asset with the royalties of its whole transaction."""
    rows = sold.select(
        F.col("tx_id").alias("tx"), "seq", "ts", "royalty", "royalty_second", F.explode("sales").alias("_s")
    ).select("tx", "seq", "ts", "_s.*", "royalty", "royalty_second")
    return rows if assets is None else rows.join(assets.select("asset"), "asset", "left_semi")


LABELLED = {"movements": "class", "sales": "detail"}


def ledger_rows(
    decoded: DataFrame,
    assets: DataFrame | None = None,
    carry: Sequence[str] = (),
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """One ledger row per transaction: movement, call and sale labels joined with a pipe.

    ``decoded`` carries movements and sales; failed transactions keep a row without labels. With
    ``assets`` only known ones are named; the labels gathered again are those of one transaction.
    Columns to ``carry`` come last. Only transactions that name an unknown asset are gathered: ``keep`` holds their ids, so
    that a join knows how few they are.
    """
    if assets is None:
        return _labelled(decoded, carry)
    each = [
        decoded.filter("ok").select(
            F.col("tx_id").alias("tx"), F.lit(column).alias("of"), F.posexplode(column).alias("pos", "_e")
        ).select("tx", "of", "pos", F.col("_e.asset"), F.col(f"_e.{what}").alias("what"))
        for column, what in LABELLED.items()
    ]
    named = each[0].unionByName(each[1])
    unknown = keep(named.select("asset").distinct().join(assets.select("asset"), "asset", "left_anti").toDF("_asset"))
    odd = keep(named.join(unknown, F.col("asset").eqNullSafe(F.col("_asset")), "left_semi").select(F.col("tx").alias("_odd")).distinct())
    entry = F.struct("pos", F.concat_ws(":", "asset", "what").alias("text"))
    entries = lambda column: F.sort_array(F.collect_list(F.when(F.col("of") == column, entry)))
    strange = F.col("tx").eqNullSafe(F.col("_odd"))
    known = named.join(odd, strange, "left_semi").join(assets.select("asset"), "asset", "left_semi")
    texts = known.groupBy("tx").agg(
        *[F.array_join(F.transform(entries(column), lambda e: e["text"]), "|").alias(f"_{column}") for column in LABELLED]
    )
    rows = _labelled(decoded, carry)
    mixed = rows.join(odd, strange, "left_semi").join(texts, "tx", "left")
    mixed = mixed.withColumns({column: F.coalesce(f"_{column}", F.lit("")) for column in LABELLED}).select(*rows.columns)
    return rows.join(odd, strange, "left_anti").unionByName(mixed)


def _labelled(decoded: DataFrame, carry: Sequence[str]) -> DataFrame:
    label = lambda items: F.array_join(F.when(F.col("ok"), items).otherwise(F.array().cast("array<string>")), "|")
    return decoded.select(
        F.col("tx_id").alias("tx"),
        "seq",
        iso_z(F.col("ts")).alias("block_time"),
        F.when(F.col("ok"), 1).otherwise(0).cast("bigint").alias("tx_success"),
        label(F.transform("movements", lambda m: F.concat_ws(":", m["asset"], m["class"]))).alias("movements"),
        label(F.transform(custody_array(), lambda w: w["action"])).alias("calls"),
        F.coalesce(
            label(F.transform("sales", lambda s: F.concat_ws(":", s["asset"], s["detail"]))), F.lit("")
        ).alias("sales"),
        *carry,
    )
