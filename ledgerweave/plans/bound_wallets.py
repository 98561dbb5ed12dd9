"""Wallet queries over the test tables: a set is a nation, its wallets are its customers."""

import uuid

from pyspark.sql import functions as F

from ledgerweave.operators import holders as H
from ledgerweave.operators import launch as L
from ledgerweave.operators import wallets as W
from ledgerweave.operators.pages import write_pages
from ledgerweave.plans import views as V
from ledgerweave.plans.bound_state import BUCKET, mints
from ledgerweave.plans.registry import bound
from ledgerweave.session import shared_dir, spool, stored

V.VIEWS["sets"] = "SELECT c_nationkey AS set_id, c_custkey AS wallet FROM customer"
V.VIEWS["sales_idx"] = "SELECT *, row_number() OVER (ORDER BY ts, tx, asset) - 1 AS idx FROM sales"
V.VIEWS["mints_idx"] = "SELECT *, row_number() OVER (ORDER BY ts, asset) - 1 AS idx FROM mints"
V.VIEWS["links"] = """
    SELECT owner AS wallet, 'current' AS kind, number AS pos FROM state WHERE burned = 0 AND owner IS NOT NULL
    UNION ALL SELECT payer, 'mint', idx FROM mints_idx
    UNION ALL SELECT buyer, 'buy', idx FROM sales_idx
    UNION ALL SELECT seller, 'sell', idx FROM sales_idx"""
V.VIEWS["trades"] = """
    SELECT set_id, idx, asset, ts, price,
           CASE WHEN max(b) = 1 AND max(s) = 1 THEN 'internal' WHEN max(b) = 1 THEN 'buy' ELSE 'sell' END AS kind
    FROM (SELECT set_id, idx, asset, ts, price, 1 AS b, 0 AS s FROM sales_idx JOIN sets ON buyer = wallet
          UNION ALL SELECT set_id, idx, asset, ts, price, 0, 1 FROM sales_idx JOIN sets ON seller = wallet)
    GROUP BY 1, 2, 3, 4, 5"""
V.VIEWS["resales"] = """
    SELECT *, kind = 'buy' OR coalesce(lag(kind) OVER (PARTITION BY set_id, asset ORDER BY idx) = 'buy', false) AS matched
    FROM trades WHERE kind <> 'internal'"""
V.VIEWS["holdings"] = "SELECT set_id, state.* FROM state JOIN sets ON owner = wallet WHERE burned = 0"
V.VIEWS["flow"] = """
    SELECT x.set_id, coalesce(purchases, 0) AS purchases, coalesce(spent, 0) AS spent,
           coalesce(matched_resales, 0) AS matched_resales, coalesce(received, 0) AS received,
           coalesce(unmatched_sales, 0) AS unmatched_sales, coalesce(internal, 0) AS internal
    FROM (SELECT DISTINCT set_id FROM trades) x
    LEFT JOIN (SELECT set_id, count(*) FILTER (kind = 'buy') AS purchases,
                      coalesce(sum(price) FILTER (kind = 'buy'), 0) AS spent,
                      count(*) FILTER (kind = 'sell' AND matched) AS matched_resales,
                      coalesce(sum(price) FILTER (kind = 'sell' AND matched), 0) AS received,
                      count(*) FILTER (kind = 'sell' AND NOT matched) AS unmatched_sales
               FROM resales GROUP BY 1) f ON f.set_id = x.set_id
    LEFT JOIN (SELECT set_id, count(*) AS internal FROM trades WHERE kind = 'internal' GROUP BY 1) i
           ON i.set_id = x.set_id"""
V.VIEWS["bench"] = """
    SELECT 'holder' AS kind, assets AS n FROM balances
    UNION ALL SELECT 'buy', count(*) FROM sales GROUP BY buyer
    UNION ALL SELECT 'mint', count(*) FROM mints GROUP BY payer"""


def sets(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("set_id"), F.col("c_custkey").alias("wallet")
    )


def narrow_sales(spark, sf_dir):
    """Sales without the columns that no trade has; they are the last to be compared, so the first line stays the same."""
    lines = V.sale_lines(spark, sf_dir).drop("royalty", "market", "shipped")
    return V.sales(spark, sf_dir, lines=lines).select("tx", "asset", "ts", "buyer", "seller", "price")


def sales_idx(spark, sf_dir):
    return W.sale_index(narrow_sales(spark, sf_dir))


def trades(spark, sf_dir, keep=stored):
    with spool(spark) as brief:
        return keep(W.set_trades(W.sale_index(narrow_sales(spark, sf_dir), brief), sets(spark, sf_dir)))


BY_TIME = ["ts", "tx"]  # order of an asset's sales where no position index is published


def deals_by_time(spark, sf_dir):
    return W.set_trades(narrow_sales(spark, sf_dir), sets(spark, sf_dir), ["tx"])


def timed(spark, sf_dir):
    """The timeline of all sets. Matched trades are held, so that their shuffles are gone before all is sorted."""
    with spool(spark) as brief:
        matched = stored(W.match_resales(trades(spark, sf_dir, brief)).drop("price"))
    return W.timeline(W.mint_index(mints(spark, sf_dir)), matched, sets(spark, sf_dir))


def bench_counts(spark, sf_dir):
    buys = V.sales(spark, sf_dir).groupBy("buyer").agg(F.count(F.lit(1)).alias("n"))
    mint_counts = mints(spark, sf_dir).groupBy("payer").agg(F.count(F.lit(1)).alias("n"))
    holders = H.holder_balances(V.state(spark, sf_dir)).select(F.lit("holder").alias("kind"), F.col("assets").alias("n"))
    return holders.unionByName(buys.select(F.lit("buy").alias("kind"), "n")).unionByName(
        mint_counts.select(F.lit("mint").alias("kind"), "n")
    )


@bound("row_index", "SELECT tx, asset, idx FROM sales_idx")
def _(spark, sf_dir):
    return sales_idx(spark, sf_dir).select("tx", "asset", "idx")


def links(spark, sf_dir):
    return W.wallet_links(V.state(spark, sf_dir), W.mint_index(mints(spark, sf_dir)), sales_idx(spark, sf_dir))


@bound(
    "wallet_index",
    """SELECT wallet, kind, pos // 4096 AS piece, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions,
              count(*) AS n FROM links GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    index = W.wallet_index(links(spark, sf_dir))
    return index.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@bound(
    "dq_assignment",
    """WITH u AS (SELECT 'current' AS kind, (SELECT count(*) FROM part) AS size
                  UNION ALL SELECT 'mint', (SELECT count(*) FROM mints)
                  UNION ALL SELECT 'buy', (SELECT count(*) FROM sales)
                  UNION ALL SELECT 'sell', (SELECT count(*) FROM sales))
       SELECT l.kind, count(*) AS n, count(*) = count(DISTINCT pos) AS assigned_once,
              min(pos) >= 0 AND max(pos) < any_value(size) AS in_range,
              count(*) = count(DISTINCT pos) AND min(pos) >= 0 AND max(pos) < any_value(size)
                  AND count(*) = any_value(size) AS exact_cover
       FROM links l JOIN u ON u.kind = l.kind GROUP BY 1""",
)
def _(spark, sf_dir):
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return W.assignment_rules(
        links(spark, sf_dir),
        size(V.table(spark, sf_dir, "part")),
        size(mints(spark, sf_dir)),
        size(V.sales(spark, sf_dir)),
    )


@bound(
    "dict_encode",
    """SELECT market, row_number() OVER (ORDER BY f) - 1 AS code
       FROM (SELECT market, min((ts, tx, asset)) AS f FROM sales GROUP BY 1)""",
)
def _(spark, sf_dir):
    return W.dict_encode(V.sales(spark, sf_dir), "market", ["ts", "tx", "asset"])


@bound(
    "dict_decode",
    """SELECT o_orderkey AS id, coalesce(list_extract(['ECONOMY', 'STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'PROMO'],
              (o_orderkey % 8) + 1), 'Unknown') AS name FROM orders""",
)
def _(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    name = W.dict_decode(F.col("o_orderkey") % 8, V.CATEGORIES, "Unknown")
    return orders.select(F.col("o_orderkey").alias("id"), name.alias("name"))


@bound(
    "benchmarks",
    """SELECT kind, n AS value, count(*) AS repeats,
              CAST(coalesce(sum(count(*)) OVER (PARTITION BY kind ORDER BY n DESC
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_rank
       FROM bench GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return W.benchmark_histogram(bench_counts(spark, sf_dir)).withColumnRenamed("n", "value")


@bound(
    "rank_against",
    """WITH a AS (SELECT set_id, 'holder' AS kind, count(*) AS amount FROM holdings GROUP BY 1
                  UNION ALL SELECT set_id, 'buy', purchases FROM flow
                  UNION ALL SELECT set_id, 'mint', count(*) FROM mints JOIN sets ON payer = wallet GROUP BY 1),
            u AS (SELECT kind, count(*) AS universe FROM bench GROUP BY 1)
       SELECT a.set_id, a.kind, a.amount,
              CASE WHEN a.amount > 0 THEN 1 + (SELECT count(*) FROM bench b WHERE b.kind = a.kind AND b.n > a.amount)
                   END AS rank,
              CASE WHEN a.amount > 0 THEN universe END AS universe,
              CASE WHEN a.amount > 0 THEN CAST(1 + (SELECT count(*) FROM bench b WHERE b.kind = a.kind
                   AND b.n > a.amount) AS DOUBLE) / universe * 100.0 END AS top_pct
       FROM a LEFT JOIN u ON u.kind = a.kind""",
)
def _(spark, sf_dir):
    members = sets(spark, sf_dir)
    held = W.set_holdings(V.state(spark, sf_dir), members).groupBy("set_id").agg(F.count(F.lit(1)).alias("amount"))
    deals = deals_by_time(spark, sf_dir)
    bought = deals.groupBy("set_id").agg(F.count_if(F.col("kind") == "buy").alias("amount"))
    minted = mints(spark, sf_dir).join(members, F.col("payer") == F.col("wallet")).groupBy("set_id")
    amounts = (
        held.withColumn("kind", F.lit("holder"))
        .unionByName(bought.withColumn("kind", F.lit("buy")))
        .unionByName(minted.agg(F.count(F.lit(1)).alias("amount")).withColumn("kind", F.lit("mint")))
    )
    levels = W.benchmark_histogram(bench_counts(spark, sf_dir)).withColumnRenamed("n", "value")
    return W.rank_against(levels, amounts)


@bound("matched_resale", "SELECT set_id, idx, asset, kind, matched FROM resales")
def _(spark, sf_dir):
    return W.match_resales(trades(spark, sf_dir)).select("set_id", "idx", "asset", "kind", "matched")


@bound(
    "market_flow",
    """SELECT set_id, purchases, CAST(spent AS DOUBLE) / 100.0 AS spent, matched_resales,
              CAST(received AS DOUBLE) / 100.0 AS received, unmatched_sales, internal,
              CAST(received - spent AS DOUBLE) / 100.0 AS net FROM flow""",
)
def _(spark, sf_dir):
    deals = stored(deals_by_time(spark, sf_dir))
    month = F.year("ts") * 12 + F.month("ts")
    flow = W.market_flow(deals, W.match_resales(deals, BY_TIME, month))
    money = {c: F.col(c).cast("double") / 100.0 for c in ["spent", "received", "net"]}
    return flow.withColumns(money)


@bound(
    "open_trail",
    """WITH l AS (SELECT set_id, asset, arg_max(kind, idx) AS last_kind FROM resales GROUP BY 1, 2)
       SELECT h.set_id, h.asset FROM holdings h LEFT JOIN l ON l.set_id = h.set_id AND l.asset = h.asset
       WHERE coalesce(last_kind, '') <> 'buy'""",
)
def _(spark, sf_dir):
    held = W.set_holdings(V.state(spark, sf_dir), sets(spark, sf_dir))
    return W.open_trail(held, deals_by_time(spark, sf_dir), BY_TIME)


@bound(
    "timeline",
    """SELECT set_id, 'mint' AS kind, strftime(ts, '%Y-%m-%d') AS date, asset, phase, idx, NULL::BOOLEAN AS matched
       FROM mints_idx JOIN sets ON payer = wallet
       UNION ALL
       SELECT set_id, kind, strftime(ts, '%Y-%m-%d'), asset, NULL, idx, matched FROM resales""",
)
def _(spark, sf_dir):
    rows = timed(spark, sf_dir)
    return rows.select("set_id", "kind", F.date_format("ts", "yyyy-MM-dd").alias("date"), "asset", "phase", "idx", "matched")


PAGE = 25
V.VIEWS["timeline_rows"] = """
    SELECT set_id, 'mint' AS kind, ts, asset, idx, 0 AS place FROM mints_idx JOIN sets ON payer = wallet
    UNION ALL SELECT set_id, kind, ts, asset, idx, 1 FROM resales"""


def timeline_keyed(spark, sf_dir):
    """The timeline with rising keys: newest first, mints before trades of the same instant, then position."""
    rows = timed(spark, sf_dir)
    late = -F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return rows.select("*", late.alias("late"), F.when(F.col("kind") == "mint", 0).otherwise(1).alias("place"))


PAGE_KEYS = ["late", "place", "idx", "asset", "kind"]


@bound(
    "timeline_pages",
    """WITH placed AS (SELECT *, (row_number() OVER (PARTITION BY set_id ORDER BY ts DESC, place, idx, asset, kind) - 1) // 25 + 1 AS page FROM timeline_rows)
       SELECT set_id, page, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS newest,
              first(idx ORDER BY ts DESC, place, idx, asset, kind) AS first_idx FROM placed GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    """The bounds of all pages of all sets, as they are stored beside the clustered rows."""
    home = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    write_pages(timeline_keyed(spark, sf_dir), home, "set_id", PAGE_KEYS, PAGE, F.expr("late div 2592000"))
    newest = F.date_format(F.timestamp_seconds(-F.col("late")), "yyyy-MM-dd").alias("newest")
    return spark.read.parquet(f"{home}/pages").select("set_id", "page", "n", newest, F.col("idx").alias("first_idx"))


_days = "strftime({}, '%Y-%m-%d')"
_cat = ", ".join(f"count(*) FILTER (category = '{c}') AS category_{i}" for i, c in enumerate(V.CATEGORIES))
_buc = ", ".join(
    f"count(*) FILTER (locked = 1 AND bucket = '{b}') AS bucket_{i}" for i, b in enumerate(H.ACTIVITY_LABELS)
)
_pha = ", ".join(f"count(*) FILTER (phase = '{p}') AS phase_{i}" for i, p in enumerate(L.PHASES))
_zero = ", ".join(
    f"coalesce({c}, 0) AS {c}"
    for c in ["assets", "locked", "minted", "originals_held"]
    + [f"category_{i}" for i in range(6)]
    + [f"bucket_{i}" for i in range(7)]
    + [f"phase_{i}" for i in range(3)]
)


@bound(
    "wallet_portfolio",
    f"""WITH h AS (SELECT *, {BUCKET} AS bucket FROM holdings),
        f AS (SELECT set_id, count(*) AS assets, count(*) FILTER (locked = 1) AS locked,
                     min(lock_ts) AS lo, max(lock_ts) AS hi, max(activity_ts) AS act, {_cat}, {_buc}
              FROM h GROUP BY 1),
        m AS (SELECT set_id, asset, phase FROM mints JOIN sets ON payer = wallet),
        c AS (SELECT set_id, count(*) AS minted, {_pha} FROM m GROUP BY 1),
        o AS (SELECT h.set_id, count(*) AS originals_held FROM h JOIN m ON m.set_id = h.set_id AND m.asset = h.asset
              GROUP BY 1)
        SELECT s.set_id, {_zero}, {_days.format('lo')} AS oldest_lock, {_days.format('hi')} AS newest_lock,
               {_days.format('act')} AS latest_activity,
               CASE WHEN coalesce(assets, 0) = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * locked / assets END AS locked_pct,
               100.0::DOUBLE * coalesce(assets, 0) / (SELECT count(owner) FROM state WHERE burned = 0) AS supply_pct,
               coalesce(minted, 0) * 1.5::DOUBLE AS mint_spend
        FROM (SELECT DISTINCT set_id FROM sets) s LEFT JOIN f ON f.set_id = s.set_id
        LEFT JOIN c ON c.set_id = s.set_id LEFT JOIN o ON o.set_id = s.set_id""",
)
def _(spark, sf_dir):
    states, members = V.state(spark, sf_dir), sets(spark, sf_dir)
    dated = states.withColumn("_as_of", V.clock(spark, sf_dir))
    rows = W.wallet_portfolio(
        W.set_holdings(dated, members),
        mints(spark, sf_dir),
        members,
        states.agg(F.count_if((F.col("burned") == 0) & F.col("owner").isNotNull())).scalar(),
        H.activity_bucket(F.col("locked"), F.col("activity_ts"), F.col("_as_of")),
        V.CATEGORIES,
        H.ACTIVITY_LABELS,
        L.PHASES,
        L.MINT_PRICE,
    )
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ["oldest_lock", "newest_lock", "latest_activity"]}
    return rows.withColumns(days)
