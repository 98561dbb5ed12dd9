"""Domain tables derived from the test tables, once as DataFrames and once as SQL text.

``sales``       lineitem joined to orders, first line per (order, part); amounts in cents
``base``        sales before 2000;  ``live``  sales from 1999 on, prices one cent higher
``state``       one row per part: the last sale fixes owner, lock and burn
``moves``       custody movements from events; asset = ``props.k``
``calls``       lock, unlock and restart calls from events
``inbox``       events as queue rows
``obs``         one market observation per day
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions.ordered import keep_first

# Fixed values of the bindings.
CATEGORIES = ["ECONOMY", "STANDARD", "SMALL", "MEDIUM", "LARGE", "PROMO"]
ORIGIN = "1995-01-01"
BURN_ABOVE = 240.0

VIEWS: dict[str, str] = {
    "sale_lines": """
        SELECT l_orderkey AS tx, l_linenumber AS line, l_suppkey AS seller, l_partkey AS asset,
               o_custkey AS buyer, o_orderdate AS ts,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
               CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) AS royalty,
               l_returnflag || l_linestatus AS market, l_shipdate AS shipped
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "sales": """
        SELECT tx, line, seller, asset, buyer, ts, price, royalty, market, shipped
        FROM (SELECT *, row_number() OVER (PARTITION BY tx, asset ORDER BY line, seller) AS rn FROM sale_lines)
        WHERE rn = 1""",
    "base": "SELECT * FROM sales WHERE ts < TIMESTAMP '2000-01-01'",
    "live": "SELECT * REPLACE (price + 1 AS price) FROM sales WHERE ts >= TIMESTAMP '1999-01-01'",
    "last_sale": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, tx DESC) AS rn FROM sales)
        WHERE rn = 1""",
    "state": """
        SELECT p_partkey AS asset, p_type AS category, CAST(p_partkey AS BIGINT) AS number,
               CASE WHEN market = 'RF' THEN 1 ELSE 0 END AS burned,
               CASE WHEN market = 'RF' THEN ts END AS burn_ts,
               CASE WHEN market = 'RF' THEN NULL ELSE buyer END AS owner,
               CASE WHEN market IN ('AO', 'RO') THEN 1 ELSE 0 END AS locked,
               CASE WHEN market IN ('AO', 'RO') THEN ts END AS lock_ts,
               CASE WHEN market IN ('AO', 'RO') AND shipped >= ts THEN shipped END AS activity_ts,
               ts AS latest_ts, tx AS latest_tx
        FROM part LEFT JOIN last_sale ON p_partkey = asset""",
    "clock": "SELECT max(o_orderdate) AS as_of FROM orders",
    "ev": """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
        FROM events""",
    "moves": """
        SELECT event_id AS tx, event_id AS seq, ts, k AS asset,
               CASE WHEN event_type = 'error' THEN 'BURN_OR_SEND_TO_ZERO' ELSE 'TRANSFER' END AS class, true AS burn_ok,
               CASE event_type WHEN 'purchase' THEN 'M' WHEN 'view' THEN 'W' || user_id ELSE 'U' || user_id END
                   AS from_owner,
               CASE event_type WHEN 'signup' THEN 'W' || user_id WHEN 'error' THEN NULL ELSE 'U' || user_id END
                   AS to_owner
        FROM ev
        WHERE event_type IN ('purchase', 'signup', 'view') OR (event_type = 'error' AND value > 240.0)""",
    "calls": """
        SELECT event_id AS tx, event_id AS seq, ts, 0 AS pos,
               CASE event_type WHEN 'signup' THEN 'LOCK' WHEN 'view' THEN 'UNLOCK' ELSE 'RESTART' END AS action,
               'U' || (user_id + CASE WHEN event_type <> 'click' AND event_id % 7 = 0 THEN 1 ELSE 0 END) AS caller,
               CASE WHEN event_type <> 'click' THEN 'W' || user_id END AS wallet
        FROM ev WHERE event_type IN ('signup', 'view', 'click')""",
    "matched": """
        SELECT m.*, c.action AS matched, c.caller, c.wallet
        FROM moves m LEFT JOIN calls c ON m.tx = c.tx AND m.class = 'TRANSFER' AND
             ((c.action = 'LOCK' AND m.to_owner = c.wallet AND m.from_owner = c.caller) OR
              (c.action = 'UNLOCK' AND m.from_owner = c.wallet AND m.to_owner = c.caller))""",
    "edge": "SELECT (max(event_id) + 1) // 2 AS cut FROM events",
    "cursors": """
        SELECT asset, max(seq) AS last_seq, arg_max(tx, seq) AS last_tx
        FROM moves, edge WHERE seq < cut AND asset % 5 <> 0 GROUP BY asset""",
    "inbox": """
        SELECT 'event-' || lpad(CAST(event_id AS VARCHAR), 20, '0') AS tx_id, ts AS received_at, event_id AS seq,
               CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'processed' ELSE 'failed' END AS status,
               event_type AS source
        FROM events""",
    "obs": """
        SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, min(CAST(round(o_totalprice * 100) AS BIGINT)) AS floor_units,
               count(*) AS listed
        FROM orders GROUP BY 1""",
}

VIEWS["last_base"] = VIEWS["last_sale"].replace("FROM sales)", "FROM base)")
VIEWS["state_base"] = VIEWS["state"].replace("last_sale", "last_base")


def with_views(sql: str) -> str:
    """Put the views that ``sql`` names, and those they need, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    heads = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if re.match(r"(?i)with\b", body):
        return f"WITH {heads},\n{body[4:].lstrip()}"
    return f"WITH {heads}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tx"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("seller"),
        F.col("l_partkey").alias("asset"),
        cents("l_extendedprice").alias("price"),
        (cents("l_extendedprice") * cents("l_tax")).alias("royalty"),
        F.concat("l_returnflag", "l_linestatus").alias("market"),
        F.col("l_shipdate").alias("shipped"),
    )
    return lines.join(order_keys(spark, sf_dir), "tx").select(*SALE_COLUMNS)


SALE_COLUMNS = ["tx", "line", "seller", "asset", "buyer", "ts", "price", "royalty", "market", "shipped"]


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("buyer"), F.col("o_orderdate").alias("ts")
    )


def sales(spark: SparkSession, sf_dir: str, dates: Column | None = None, lines: DataFrame | None = None) -> DataFrame:
    """First line per (tx, asset). The date belongs to the tx, so ``dates`` is applied before the lines are compared.

    ``lines``: the rows of ``sale_lines``, if they are held already.
    """
    rows = sale_lines(spark, sf_dir) if lines is None else lines
    return keep_first(rows if dates is None else rows.filter(dates), ["tx", "asset"], ["line", "seller"])


def base(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    return sales(spark, sf_dir, F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz"), lines)


def live(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    later = sales(spark, sf_dir, F.col("ts") >= F.lit("1999-01-01").cast("timestamp_ntz"), lines)
    return later.withColumn("price", F.col("price") + 1)


def state(spark: SparkSession, sf_dir: str, dates: Column | None = None) -> DataFrame:
    rows = sale_lines(spark, sf_dir)
    rows = rows if dates is None else rows.filter(dates)
    return state_of(spark, sf_dir, rows.groupBy("asset").agg(F.max(line_order()).alias("_last")))


def line_order() -> Column:
    """The greatest is the first line of the last sale: greatest (ts, tx), there the least (line, seller)."""
    order = [F.col("ts"), F.col("tx"), (-F.col("line")).alias("_line"), (-F.col("seller")).alias("_seller")]
    return F.struct(*order, "buyer", "market", "shipped")


def state_of(spark: SparkSession, sf_dir: str, lasts: DataFrame) -> DataFrame:
    """State of all parts from the greatest ``line_order`` of each asset, ``_last``; other columns are kept."""
    more = [c for c in lasts.columns if c not in ("asset", "_last")]
    last = lasts.select("asset", *more, *[F.col(f"_last.{c}") for c in ("ts", "tx", "buyer", "market", "shipped")])
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), F.col("p_type").alias("category"))
    burned = F.col("market") == "RF"
    locked = F.col("market").isin("AO", "RO")
    return parts.join(last, "asset", "left").select(
        "asset",
        "category",
        F.col("asset").alias("number"),
        F.when(burned, 1).otherwise(0).cast("bigint").alias("burned"),
        F.when(burned, F.col("ts")).alias("burn_ts"),
        F.when(F.coalesce(~burned, F.lit(True)), F.col("buyer")).alias("owner"),
        F.when(locked, 1).otherwise(0).cast("bigint").alias("locked"),
        F.when(locked, F.col("ts")).alias("lock_ts"),
        F.when(locked & (F.col("shipped") >= F.col("ts")), F.col("shipped")).alias("activity_ts"),
        F.col("ts").alias("latest_ts"),
        F.col("tx").alias("latest_tx"),
        *more,
    )


def clock(spark: SparkSession, sf_dir: str) -> Column:
    """Evaluation instant of the state products, read from the data."""
    return table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _named(prefix: str, ident: Column) -> Column:
    return F.concat(F.lit(prefix), ident.cast("string"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    what, user = F.col("event_type"), F.col("user_id")
    kept = ev(spark, sf_dir).filter(
        what.isin("purchase", "signup", "view") | ((what == "error") & (F.col("value") > BURN_ABOVE))
    )
    return kept.select(
        F.col("event_id").alias("tx"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("k").alias("asset"),
        F.when(what == "error", "BURN_OR_SEND_TO_ZERO").otherwise("TRANSFER").alias("class"),
        F.lit(True).alias("burn_ok"),
        F.when(what == "purchase", "M")
        .when(what == "view", _named("W", user))
        .otherwise(_named("U", user))
        .alias("from_owner"),
        F.when(what == "signup", _named("W", user))
        .when(what != "error", _named("U", user))
        .alias("to_owner"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    what, user = F.col("event_type"), F.col("user_id")
    other = F.when((what != "click") & (F.col("event_id") % 7 == 0), 1).otherwise(0)
    return (
        ev(spark, sf_dir)
        .filter(what.isin("signup", "view", "click"))
        .select(
            F.col("event_id").alias("tx"),
            F.col("event_id").alias("seq"),
            "ts",
            F.lit(0).alias("pos"),
            F.when(what == "signup", "LOCK").when(what == "view", "UNLOCK").otherwise("RESTART").alias("action"),
            _named("U", user + other).alias("caller"),
            F.when(what != "click", _named("W", user)).alias("wallet"),
        )
    )


def edge(spark: SparkSession, sf_dir: str) -> Column:
    """Sequence number up to which the cursor table has been written."""
    return table(spark, sf_dir, "events").agg(F.expr("(max(event_id) + 1) div 2")).scalar()


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = moves(spark, sf_dir).filter((F.col("seq") < edge(spark, sf_dir)) & (F.col("asset") % 5 != 0))
    return done.groupBy("asset").agg(F.max("seq").alias("last_seq"), F.max_by("tx", "seq").alias("last_tx"))


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("event-"), F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("tx_id"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("seq"),
        F.when(turn == 0, "pending").when(turn == 1, "processed").otherwise("failed").alias("status"),
        F.col("event_type").alias("source"),
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
        .agg(F.min(cents("o_totalprice")).alias("floor_units"), F.count(F.lit(1)).alias("listed"))
    )
