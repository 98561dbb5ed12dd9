"""Decode queries: transaction JSON is built from the flat tables and decoded back.

Each sale line becomes one market transaction and each event one custody transaction. Instruction
data is hex text in these payloads so that SQL can follow it; base-58 is checked by ``decode_data``.
"""

from pyspark.sql import functions as F

from ledgerweave import constants as K
from ledgerweave.functions.scalars import base58_to_binary, uint_le
from ledgerweave.operators import decode as D
from ledgerweave.plans import views as V
from ledgerweave.plans.registry import bound
from ledgerweave.sources.tx_json import scan_tx

ME, TM, AMM = K.SALE_LAYOUTS
PROGRAM_OF = {"R": ME, "A": TM, "N": AMM}


def le_hex(amount, width):
    """Little-endian hex text of a non-negative integer."""
    byte = lambda i: F.shiftleft(F.shiftright(amount, 8 * i).bitwiseAND(F.lit(255)), 8 * (width - 1 - i))
    swapped = byte(0)
    for i in range(1, width):
        swapped = swapped.bitwiseOR(byte(i))
    return F.lpad(F.hex(swapped), 2 * width, "0")


def ints(*numbers):
    return F.array(*[F.lit(str(n)) for n in numbers])


def instruction(program, accounts, data):
    return F.struct(F.lit(program).alias("programIdIndex"), accounts.alias("accounts"), data.alias("data"))


def lines(sales):
    tx, asset, seller, line = [F.col(c).cast("string") for c in ("tx", "asset", "seller", "line")]
    return sales.select(
        F.concat_ws("-", F.lit("transaction"), tx, asset, seller, line).alias("tx_id"),
        F.col("tx").alias("num"),
        F.concat(F.lit("P"), asset).alias("item"),
        F.concat(F.lit("C"), F.col("buyer").cast("string")).alias("buyer"),
        F.concat(F.lit("S"), seller).alias("seller"),
        "ts",
        "price",
        "royalty",
        F.substring("market", 1, 1).alias("place"),
    )


V.VIEWS["jlines"] = """
    SELECT 'transaction-' || tx || '-' || asset || '-' || seller || '-' || line AS tx_id, tx AS num,
           'P' || asset AS item, 'C' || buyer AS buyer, 'S' || seller AS seller, ts, price, royalty,
           substr(market, 1, 1) AS place, tx % 23 = 0 AS burning, tx % 29 <> 0 AS ok
    FROM sale_lines"""


def market_tx(sales):
    """Inbox rows with one sale line each; every 23rd order burns instead, every 29th failed.

    Keys: 0 buyer, 1 seller, 2 asset, 3 and 4 token accounts, 5 marketplace, 6 system, 7 token
    program, 8 and 9 royalty recipients (loaded addresses).
    """
    num, place = F.col("num"), F.col("place")
    program = F.when(place == "R", ME.program).when(place == "A", TM.program).otherwise(AMM.program)
    pad = lambda n: F.lit("00" * n)
    price = le_hex(F.col("price"), 8)
    buy_accounts = (
        F.when(place == "R", ints(0, 1, 4, 4, 2))
        .when(place == "A", ints(4, 0, 4, 4, 4, 2, 1))
        .otherwise(ints(4, 0, 4, 4, 4, 4, 4, 1, 4, 4, 4, 4, 4, 4, 2))
    )
    buy_data = (
        F.when(place == "R", F.concat(F.lit(ME.buy_prefix), pad(2), price))
        .when(place == "A", F.lit(TM.buy_prefix))
        .otherwise(F.lit(AMM.buy_prefix))
    )
    event_data = F.when(place == "A", F.concat(F.lit(TM.event_prefix), pad(69), price)).otherwise(
        F.concat(F.lit(AMM.event_prefix), pad(1), price)
    )
    pay = lambda key, amount: instruction(
        6, ints(0, key), F.concat(F.lit("02000000"), le_hex(amount, 8))
    )
    burning = num % 23 == 0
    burn = instruction(7, ints(3, 2, 1), F.when(num % 2 == 0, "0F").otherwise("07"))
    buy = instruction(5, buy_accounts, buy_data)
    outer = F.when(burning, F.array(burn)).otherwise(F.array(pay(8, F.col("royalty")), buy))
    stray = instruction(99, ints(0), F.lit("00"))
    event = instruction(5, ints(0, 77), event_data)
    inner = F.array(
        F.struct(
            F.lit(1).alias("index"),
            F.array(event, pay(9, F.expr("royalty div 9")), stray).alias("instructions"),
        )
    )
    balance = lambda key, owner, amount: F.struct(
        F.lit(key).alias("accountIndex"),
        F.col("item").alias("mint"),
        F.col(owner).alias("owner"),
        F.struct(F.lit(amount).alias("amount")).alias("uiTokenAmount"),
    )
    post = F.when(burning, F.array(balance(3, "seller", "0"))).otherwise(
        F.array(balance(3, "seller", "0"), balance(4, "buyer", "1"))
    )
    account = lambda mark: F.concat_ws("/", F.lit(mark), F.col("item"))
    payload = F.struct(
        (num + 1).alias("slot"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("blockTime"),
        F.struct(
            F.array("tx_id").alias("signatures"),
            F.struct(
                F.struct(F.lit(1).alias("numRequiredSignatures")).alias("header"),
                F.array(
                    F.col("buyer"), F.col("seller"), F.col("item"), account("from"), account("to"), program,
                    F.lit(K.SYSTEM_PROGRAM), F.lit(K.TOKEN_PROGRAMS[0]),
                ).alias("accountKeys"),
                outer.alias("instructions"),
            ).alias("message"),
        ).alias("transaction"),
        F.struct(
            F.when(num % 29 == 0, "InstructionError").alias("err"),
            inner.alias("innerInstructions"),
            F.array(balance(3, "seller", "1")).alias("preTokenBalances"),
            post.alias("postTokenBalances"),
            F.struct(F.array(F.lit(K.ROYALTY_FIRST)).alias("writable"), F.array(F.lit(K.ROYALTY_SECOND)).alias("readonly")).alias(
                "loadedAddresses"
            ),
        ).alias("meta"),
    )
    return lines(sales).select(
        "tx_id",
        F.col("ts").cast("timestamp").alias("received_at"),
        (num + 1).alias("slot"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("block_time"),
        F.to_json(payload).alias("payload"),
    )


def scanned_market(spark, sf_dir, parts=D.PARTS):
    return scan_tx(market_tx(V.sale_lines(spark, sf_dir)), F.lit("2100-01-01").cast("timestamp"), parts)


def market(spark, sf_dir, parts=D.PARTS):
    return D.decode_tx(scanned_market(spark, sf_dir, parts), "hex", parts=parts)


V.VIEWS["events_tx"] = """
    SELECT 'event-' || lpad(CAST(event_id AS VARCHAR), 20, '0') AS tx, event_id, 'U' || user_id AS caller,
           'W' || user_id AS wallet, CASE event_type WHEN 'signup' THEN 'LOCK' WHEN 'view' THEN 'UNLOCK'
                WHEN 'click' THEN 'RESTART' END AS action
    FROM events"""


def custody_tx(spark, sf_dir):
    """Inbox rows with one custody call per event, repeated in every third one.

    Every 13th names too few accounts and every 17th has no signer; keys are objects with flags.
    """
    ident, what = F.col("event_id"), F.col("event_type")
    data = (
        F.when(what == "signup", K.LOCK_PREFIX)
        .when(what == "view", K.UNLOCK_PREFIX)
        .when(what == "click", K.RESTART_PREFIX)
        .otherwise("ffffffffffffffff")
    )
    accounts = F.when(ident % 13 == 0, ints(0, 0, 0)).otherwise(ints(0, 0, 0, 1))
    call = instruction(2, accounts, data)
    key = lambda name, flag: F.struct(name.alias("pubkey"), flag.alias("signer"))
    user = F.col("user_id").cast("string")
    payload = F.struct(
        (ident + 1).alias("slot"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("blockTime"),
        F.struct(
            F.array("tx_id").alias("signatures"),
            F.struct(
                F.array(
                    key(F.concat(F.lit("U"), user), ident % 17 != 0),
                    key(F.concat(F.lit("W"), user), F.lit(False)),
                    key(F.lit(K.CUSTODY_PROGRAM), F.lit(False)),
                ).alias("accountKeys"),
                F.when(ident % 3 == 0, F.array(call, call)).otherwise(F.array(call)).alias("instructions"),
            ).alias("message"),
        ).alias("transaction"),
        F.struct(F.lit(None).cast("string").alias("err")).alias("meta"),
    )
    named = F.concat(F.lit("event-"), F.lpad(ident.cast("string"), 20, "0"))
    return (
        V.table(spark, sf_dir, "events")
        .withColumn("tx_id", named)
        .select(
            "tx_id",
            F.col("ts").cast("timestamp").alias("received_at"),
            (ident + 1).alias("slot"),
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("block_time"),
            F.to_json(payload).alias("payload"),
        )
    )


def scanned_custody(spark, sf_dir, parts=D.PARTS):
    return scan_tx(custody_tx(spark, sf_dir), F.lit("2100-01-01").cast("timestamp"), parts)


def custody(spark, sf_dir):
    return D.decode_tx(scanned_custody(spark, sf_dir, ("signers", "calls")), "hex", parts=("signers", "calls"))


@bound(
    "scan_tx_json",
    """SELECT tx_id, CASE num % 19 WHEN 1 THEN 'payload is not text' WHEN 2 THEN 'payload is not an object'
              WHEN 3 THEN 'signature mismatch' WHEN 4 THEN 'invalid slot' WHEN 5 THEN 'missing block time'
              WHEN 6 THEN 'block time mismatch'
              ELSE CASE WHEN ts > TIMESTAMP '2001-01-01' THEN 'outside snapshot' END END AS reason
       FROM jlines""",
)
def _(spark, sf_dir):
    turn = (F.col("slot") - 1) % 19
    good = F.col("payload")
    damaged = (
        F.when(turn == 1, None)
        .when(turn == 2, F.lit("[1, 2]"))
        .when(turn == 3, F.regexp_replace(good, '"transaction-', '"other-'))
        .when(turn == 4, F.regexp_replace(good, '"slot":[0-9]+', '"slot":-5'))
        .when(turn == 5, F.regexp_replace(good, '"blockTime":[0-9]+,', ""))
        .otherwise(good)
    )
    shift = F.when(turn == 6, F.col("block_time") + 1).otherwise(F.col("block_time"))
    rows = market_tx(V.sale_lines(spark, sf_dir)).withColumns({"payload": damaged, "block_time": shift})
    return scan_tx(rows, F.lit("2001-01-01").cast("timestamp")).select("tx_id", "reason")


@bound(
    "account_keys",
    f"""SELECT tx_id, concat_ws(',', buyer, seller, item, 'from/' || item, 'to/' || item,
               CASE place WHEN 'R' THEN '{ME.program}' WHEN 'A' THEN '{TM.program}' ELSE '{AMM.program}' END,
               '{K.SYSTEM_PROGRAM}', '{K.TOKEN_PROGRAMS[0]}', '{K.ROYALTY_FIRST}', '{K.ROYALTY_SECOND}') AS keys
        FROM jlines""",
)
def _(spark, sf_dir):
    return D.with_keys(scanned_market(spark, sf_dir, ())).select("tx_id", F.array_join("keys", ",").alias("keys"))


@bound(
    "tx_signers",
    """SELECT tx_id, buyer AS actor FROM jlines
       UNION ALL SELECT tx, CASE WHEN event_id % 17 <> 0 THEN caller END FROM events_tx""",
)
def _(spark, sf_dir):
    acting = lambda scanned: D.with_keys(scanned, "signers").select("tx_id", "signers")
    both = acting(scanned_market(spark, sf_dir, ("signers",))).unionByName(acting(scanned_custody(spark, sf_dir, ("signers",))))
    return both.select("tx_id", F.get("signers", 0).alias("actor"))


V.VIEWS["jcalls"] = f"""
    WITH p AS (SELECT *, CASE place WHEN 'R' THEN '{ME.program}' WHEN 'A' THEN '{TM.program}' ELSE '{AMM.program}' END
                      AS program,
                      CASE place WHEN 'R' THEN buyer || ',' || seller || ',to/' || item || ',to/' || item || ',' || item
                           WHEN 'A' THEN 'to/' || item || ',' || buyer || repeat(',to/' || item, 3) || ',' || item || ',' || seller
                           ELSE 'to/' || item || ',' || buyer || repeat(',to/' || item, 5) || ',' || seller
                                || repeat(',to/' || item, 6) || ',' || item END AS buy_accounts FROM jlines)
    SELECT tx_id, 0 AS pos, 0 AS outer_idx, '{K.TOKEN_PROGRAMS[0]}' AS program, 'from/' || item || ',' || item || ',' || seller AS accounts
    FROM p WHERE burning
    UNION ALL SELECT tx_id, 0, 0, '{K.SYSTEM_PROGRAM}', buyer || ',{K.ROYALTY_FIRST}' FROM p WHERE NOT burning
    UNION ALL SELECT tx_id, 1, 1, program, buy_accounts FROM p WHERE NOT burning
    UNION ALL SELECT tx_id, CASE WHEN burning THEN 1 ELSE 2 END, 1, program, buyer FROM p
    UNION ALL SELECT tx_id, CASE WHEN burning THEN 2 ELSE 3 END, 1, '{K.SYSTEM_PROGRAM}', buyer || ',{K.ROYALTY_SECOND}' FROM p"""


@bound("flatten_instructions", "SELECT tx_id, CAST(pos AS BIGINT) AS pos, CAST(outer_idx AS BIGINT) AS outer_idx, program FROM jcalls")
def _(spark, sf_dir):
    rows = D.call_rows(market(spark, sf_dir, ("calls",)))
    return rows.select("tx_id", "pos", F.col("outer").alias("outer_idx"), "program")


@bound("resolve_accounts", "SELECT tx_id, CAST(pos AS BIGINT) AS pos, accounts FROM jcalls")
def _(spark, sf_dir):
    return D.call_rows(market(spark, sf_dir, ("calls",))).select("tx_id", "pos", F.array_join("accounts", ",").alias("accounts"))


@bound(
    "decode_data",
    """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN '11' ELSE '' END || 'Z' || translate(
                      CAST(o_orderkey * 7919 + o_custkey AS VARCHAR) || CAST(CAST(round(o_totalprice * 100) AS BIGINT)
                      AS VARCHAR), '0', CASE WHEN o_orderkey % 31 = 0 THEN 'O' ELSE 'y' END) AS text FROM orders),
            d AS (SELECT id, text, list_reduce(list_transform(string_split(ltrim(text, '1'), ''), lambda c:
                      CAST(instr('123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz', c) - 1 AS HUGEINT)),
                      lambda a, b: a * 58 + b) AS n FROM t),
            h AS (SELECT *, format('{:X}', n) AS x FROM d)
       SELECT id, text, CASE WHEN contains(text, 'O') THEN NULL ELSE CASE WHEN text LIKE '11%' THEN '0000' ELSE '' END ||
              CASE WHEN length(x) % 2 = 1 THEN '0' ELSE '' END || x END AS data FROM h""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    digits = F.concat((key * 7919 + F.col("o_custkey")).cast("string"), V.cents("o_totalprice").cast("string"))
    shown = F.when(key % 31 == 0, F.translate(digits, "0", "O")).otherwise(F.translate(digits, "0", "y"))
    text = F.concat(F.when(key % 9 == 0, "11").otherwise(""), F.lit("Z"), shown)
    rows = V.table(spark, sf_dir, "orders").select(key.alias("id"), text.alias("text"))
    return rows.select("id", "text", F.hex(base58_to_binary(F.col("text"))).alias("data"))


@bound(
    "le_field",
    """SELECT l_orderkey AS tx, l_linenumber AS line, l_partkey AS asset, l_suppkey AS seller,
              CAST(round(l_extendedprice * 100) AS VARCHAR).replace('.0', '') AS amount, '2' AS code, NULL::VARCHAR AS short
       FROM lineitem""",
)
def _(spark, sf_dir):
    price = V.cents("l_extendedprice")
    data = F.unhex(F.concat(F.lit("02000000"), le_hex(price, 8)))
    text = lambda c: c.cast("string")
    return (
        V.table(spark, sf_dir, "lineitem")
        .withColumn("data", data)
        .select(
            F.col("l_orderkey").alias("tx"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("asset"),
            F.col("l_suppkey").alias("seller"),
            text(uint_le(F.col("data"), 5, 8)).alias("amount"),
            text(uint_le(F.col("data"), 1, 4)).alias("code"),
            text(uint_le(F.col("data"), 6, 8)).alias("short"),
        )
    )


CLASSIFIED = """
    SELECT tx, action, caller, CASE WHEN action <> 'RESTART' THEN wallet END AS wallet FROM events_tx
    WHERE action IS NOT NULL AND event_id % 17 <> 0 AND (action = 'RESTART' OR event_id % 13 <> 0)"""


@bound("classify_calls", f"{CLASSIFIED} UNION ALL {CLASSIFIED} AND event_id % 3 = 0")
def _(spark, sf_dir):
    return D.custody_calls(custody(spark, sf_dir), distinct=False).select("tx", "action", "caller", "wallet")


@bound("calls_dedup", CLASSIFIED)
def _(spark, sf_dir):
    return D.custody_calls(custody(spark, sf_dir)).select("tx", "action", "caller", "wallet")


@bound(
    "balance_movements",
    """SELECT tx_id AS tx, item AS asset, CASE WHEN burning THEN 'BURN_OR_SEND_TO_ZERO' ELSE 'TRANSFER' END AS class,
              seller AS from_owner, CASE WHEN NOT burning THEN buyer END AS to_owner FROM jlines""",
)
def _(spark, sf_dir):
    rows = D.movement_rows(D.with_movements(D.with_keys(scanned_market(spark, sf_dir, ("balances",)), "balances")))
    return rows.select("tx", "asset", "class", "from_owner", "to_owner")


@bound("burn_exists", "SELECT tx_id AS tx, item AS asset, num % 2 = 0 AS burn_ok FROM jlines WHERE burning")
def _(spark, sf_dir):
    rows = D.movement_rows(D.with_movements(market(spark, sf_dir, ("calls", "balances"))))
    return rows.filter(F.col("class") == "BURN_OR_SEND_TO_ZERO").select("tx", "asset", "burn_ok")


@bound(
    "positive_accounts",
    """SELECT tx_id AS tx, item AS asset, 'from/' || item AS before, CASE WHEN NOT burning THEN 'to/' || item END AS after,
              false AS ambiguous FROM jlines""",
)
def _(spark, sf_dir):
    held = D.positive_accounts(D.with_movements(D.with_keys(scanned_market(spark, sf_dir, ("balances",)), "balances")))
    return held.select("tx", "asset", "before", "after", "ambiguous")


@bound(
    "royalty_by_tx",
    """SELECT tx_id, CASE WHEN burning THEN 0 ELSE royalty END AS royalty, royalty // 9 AS royalty_second FROM jlines""",
)
def _(spark, sf_dir):
    rows = D.with_royalties(market(spark, sf_dir, ("calls",)))
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select("tx_id", whole("royalty"), whole("royalty_second"))


V.VIEWS["jsales"] = f"""
    SELECT tx_id AS tx, item AS asset, buyer, seller, price, royalty, royalty // 9 AS royalty_second,
           CASE place WHEN 'R' THEN '{ME.detail}' WHEN 'A' THEN '{TM.detail}' ELSE '{AMM.detail}' END AS detail,
           CASE place WHEN 'R' THEN '{ME.method}' WHEN 'A' THEN '{TM.method}' ELSE '{AMM.method}' END AS method
    FROM jlines WHERE ok AND NOT burning"""


def decoded_sales(spark, sf_dir, layouts=tuple(K.SALE_LAYOUTS), assets=None):
    sold = D.with_sales(D.with_royalties(market(spark, sf_dir, ("calls",))), layouts)
    rows = D.sale_rows(sold, assets)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("price", "royalty", "royalty_second")})


@bound("sales_single", f"SELECT tx, asset, buyer, seller, price, method FROM jsales WHERE detail = '{ME.detail}'")
def _(spark, sf_dir):
    return decoded_sales(spark, sf_dir, [ME]).select("tx", "asset", "buyer", "seller", "price", "method")


@bound("sales_paired", f"SELECT tx, asset, buyer, seller, price, method FROM jsales WHERE detail <> '{ME.detail}'")
def _(spark, sf_dir):
    return decoded_sales(spark, sf_dir, [TM, AMM]).select("tx", "asset", "buyer", "seller", "price", "method")


@bound(
    "sales_decode",
    "SELECT tx, asset, buyer, seller, price, royalty, royalty_second, detail FROM jsales WHERE CAST(substr(asset, 2) AS BIGINT) % 7 <> 0",
)
def _(spark, sf_dir):
    known = V.table(spark, sf_dir, "part").filter(F.col("p_partkey") % 7 != 0)
    assets = known.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("asset"))
    rows = decoded_sales(spark, sf_dir, assets=assets)
    return rows.select("tx", "asset", "buyer", "seller", "price", "royalty", "royalty_second", "detail")


@bound(
    "tx_ledger",
    """SELECT l.tx_id AS tx, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS block_time, CASE WHEN ok THEN 1 ELSE 0 END::BIGINT AS tx_success,
              CASE WHEN NOT ok THEN '' WHEN burning THEN item || ':BURN_OR_SEND_TO_ZERO' ELSE item || ':TRANSFER' END AS movements,
              '' AS calls, CASE WHEN ok AND NOT burning THEN item || ':' || CASE place WHEN 'R' THEN 'Magic Eden V2'
                   WHEN 'A' THEN 'Tensor Marketplace' ELSE 'Tensor AMM' END ELSE '' END AS sales
       FROM jlines l""",
)
def _(spark, sf_dir):
    sold = D.with_sales(D.with_movements(market(spark, sf_dir)))
    return D.ledger_rows(sold).select("tx", "block_time", "tx_success", "movements", "calls", "sales")
