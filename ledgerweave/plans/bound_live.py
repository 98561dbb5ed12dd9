"""The live batch end to end: transaction JSON arrives in slices, is landed, reduced at two instants and committed.

Each first line of an (order, asset) is one transaction with a sale or a burn. Half of the arrivals come before the first
instant. Transactions that the reducer must not guess about (a burn without its instruction) arrive in an inbox of their own
and end in the quarantine table.
"""

from pyspark.sql import functions as F

from ledgerweave.operators.kept import kept_daily_activity, kept_holder_balances, kept_state_kpis
from ledgerweave.plans import views as V
from ledgerweave.plans.bound_decode import market_tx
from ledgerweave.plans.bound_stream import FILES, arrivals, workspace
from ledgerweave.plans.once import built_once
from ledgerweave.plans.registry import ORACLES, bound
from ledgerweave.session import remove
from ledgerweave.sources.tables import read_appended, read_latest
from ledgerweave.streaming.batches import UnresolvedBatch, recover, reduce_pending, run_inbox
from ledgerweave.streaming.products import follow

FIRST, LAST = "1998-01-01", "2100-01-01"

V.VIEWS["first_lines"] = """
    SELECT * FROM jlines QUALIFY row_number() OVER
      (PARTITION BY num, item ORDER BY CAST(split_part(tx_id, '-', 5) AS BIGINT), CAST(substr(seller, 2) AS BIGINT), price, royalty) = 1"""
V.VIEWS["live_lines"] = """
    SELECT * FROM first_lines WHERE NOT (burning AND num % 2 = 1)"""
V.VIEWS["live_turns"] = "SELECT *, CASE WHEN ts <= TIMESTAMP '1998-01-01' THEN 1 ELSE 2 END AS turn FROM live_lines"
# A movement of the second batch that the first one's cursor has passed is stale.
V.VIEWS["live_moves"] = """
    SELECT t.*, CASE WHEN turn = 2 AND num <= (SELECT max(num) FROM live_turns f WHERE f.turn = 1 AND f.ok AND f.item = t.item)
                     THEN 'STALE' ELSE 'APPLY' END AS status
    FROM live_turns t WHERE ok"""


def incoming(spark, sf_dir, fine):
    """First lines whose transactions arrive by ``slot``; ``fine`` ones can be reduced, the others cannot."""
    odd = (F.col("tx") % 23 == 0) & (F.col("tx") % 2 == 1)
    return V.sales(spark, sf_dir).filter(~odd if fine else odd).withColumn("slot", F.col("tx") + 1)


def known_assets(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("asset"))


def instant(text):
    return F.lit(text).cast("timestamp")


def run_both(spark, sf_dir):
    """Run both batches; returns the folder of the tables."""
    home = workspace(spark, "live")
    files = max(FILES, spark.sparkContext.defaultParallelism)  # landing takes them in any order, so all cores may write
    stream = arrivals(spark, incoming(spark, sf_dir, True), "slot", f"{home}/in", market_tx, "delete", files)
    assets, past = known_assets(spark, sf_dir), instant("1900-01-01")
    run_inbox(stream, home, f"{home}/checkpoint", assets, instant(FIRST), past, "hex", lambda: remove(spark, f"{home}/in"))
    reduce_pending(spark, home, assets, instant(LAST), past, "hex")
    return f"{home}/tables"


def live(spark, sf_dir):
    return built_once(spark, sf_dir, ["lineitem", "orders", "part"], run_both)


@bound(
    "live_batch_state",
    """SELECT 'P' || p_partkey AS asset, coalesce(burned, 0)::BIGINT AS burned, owner, m.tx_id AS latest_tx FROM part LEFT JOIN
         (SELECT item, max(CASE WHEN burning THEN 1 ELSE 0 END) AS burned, arg_max(tx_id, num) AS tx_id,
                 arg_max(CASE WHEN burning THEN '-' ELSE buyer END, num) AS o, nullif(o, '-') AS owner
          FROM live_moves WHERE status = 'APPLY' GROUP BY item) m ON item = 'P' || p_partkey""",
)
def _(spark, sf_dir):
    return read_latest(spark, live(spark, sf_dir), "state").select("asset", "burned", "owner", "latest_tx")


@bound(
    "live_batch_sales",
    "SELECT tx_id AS tx, item AS asset, buyer, seller, price, royalty FROM live_lines WHERE ok AND NOT burning",
)
def _(spark, sf_dir):
    rows = read_appended(spark, live(spark, sf_dir), "sales")
    amounts = [F.col(c).cast("bigint").alias(c) for c in ("price", "royalty")]
    return rows.select("tx", "asset", "buyer", "seller", *amounts)


@bound(
    "live_batch_ledger",
    """SELECT tx_id AS tx, num + 1 AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS block_time,
              strftime(ts, '%Y-%m-%d') AS received, 'RAW_INBOX' AS source, CASE WHEN ok THEN 1 ELSE 0 END::BIGINT AS tx_success,
              CASE WHEN NOT ok THEN '' WHEN burning THEN item || ':BURN_OR_SEND_TO_ZERO' ELSE item || ':TRANSFER' END AS movements
       FROM live_lines""",
)
def _(spark, sf_dir):
    rows = read_appended(spark, live(spark, sf_dir), "ledger")
    received = F.date_format("received_at", "yyyy-MM-dd").alias("received")
    return rows.select("tx", "seq", "block_time", received, "source", "tx_success", "movements")


@bound(
    "live_batch_manifest",
    "SELECT tx_id, num + 1 AS seq, CAST(NULL AS VARCHAR) AS note FROM live_lines",
)
def _(spark, sf_dir):
    """Ids of both batches: each arrival is acknowledged once."""
    return read_appended(spark, live(spark, sf_dir), "manifest").select("tx_id", "seq", "note")


@bound("live_batch_recover", "SELECT tx_id FROM live_turns WHERE turn = 2")
def _(spark, sf_dir):
    """After a stop behind the last commit: exactly its ids again."""
    return recover(spark, live(spark, sf_dir).removesuffix("/tables"))


@bound(
    "live_batch_counters",
    """SELECT 'MOVEMENT_' || status AS counter, count(*) AS n FROM live_moves WHERE turn = 2 GROUP BY 1
       UNION ALL SELECT CASE WHEN burning THEN 'BURN' ELSE 'TRANSFER' END, count(*) FROM live_moves
         WHERE turn = 2 AND status = 'APPLY' GROUP BY 1
       UNION ALL SELECT 'SALE', count(*) FROM live_moves WHERE turn = 2 AND NOT burning
       UNION ALL SELECT 'FAILED_TX', count(*) FROM live_turns WHERE turn = 2 AND NOT ok
       UNION ALL SELECT 'RESTART_ASSET_UPDATES', 0""",
)
def _(spark, sf_dir):
    """Counters of the second batch."""
    return read_latest(spark, live(spark, sf_dir), "counters")


@bound(
    "live_batch_checkpoint",
    """SELECT count(*) AS n, count(*) AS reduced, max(num) + 1 AS last_seq, true AS unique_ids, true AS no_blank_ids
       FROM live_turns WHERE turn = 2""",
)
def _(spark, sf_dir):
    return read_latest(spark, live(spark, sf_dir), "checkpoint").select("n", "reduced", "last_seq", "unique_ids", "no_blank_ids")


@bound(
    "live_batch_quarantine",
    """SELECT tx_id AS tx, item AS asset, 'sent without burn instruction' AS reason FROM first_lines
       WHERE burning AND ok AND num % 2 = 1""",
)
def _(spark, sf_dir):
    """A batch that must not be reduced: every case is kept with its reason, nothing is committed."""
    home = workspace(spark, "quarantine")
    stream = arrivals(spark, incoming(spark, sf_dir, False), "slot", f"{home}/in", market_tx)
    try:
        run_inbox(stream, home, f"{home}/checkpoint", known_assets(spark, sf_dir), instant(LAST), instant("1900-01-01"), "hex")
    except UnresolvedBatch:
        pass
    if read_appended(spark, f"{home}/tables", "ledger") is not None:
        raise AssertionError("an unresolved batch was committed")
    rows = read_appended(spark, f"{home}/quarantine", "rows")
    if rows is None:  # no such transaction in the input
        rows = spark.createDataFrame([], "tx string, asset string, reason string")
    return rows.select("tx", "asset", "reason")


def followed(spark, sf_dir):
    """The products after the first batch, then after the second."""
    tables, products = live(spark, sf_dir), f"{workspace(spark, 'followed')}/tables"
    assets = known_assets(spark, sf_dir).select("asset", F.lit("ANY").alias("category"), F.lit(V.ORIGIN).cast("timestamp_ntz").alias("origin"))
    follow(spark, tables, products, assets, 0)
    follow(spark, tables, products, assets)
    return products


def live_products(spark, sf_dir):
    return built_once(spark, sf_dir, ["lineitem", "orders", "part"], followed)


_final = ORACLES["live_batch_state"]


@bound("live_kept_kpis")
def _(spark, sf_dir):
    one = kept_state_kpis(spark, live_products(spark, sf_dir), V.clock(spark, sf_dir))
    return one.select("active_supply", "holders", "burned")


ORACLES["live_kept_kpis"] = f"""SELECT count(*) FILTER (burned = 0) AS active_supply, count(DISTINCT owner) FILTER (burned = 0) AS holders,
       count(*) FILTER (burned = 1) AS burned FROM ({_final})"""


@bound("live_kept_balances")
def _(spark, sf_dir):
    return kept_holder_balances(spark, live_products(spark, sf_dir))


ORACLES["live_kept_balances"] = f"SELECT owner, count(*) AS assets FROM ({_final}) WHERE burned = 0 AND owner IS NOT NULL GROUP BY 1"


@bound(
    "live_kept_daily",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS sales, CAST(sum(price) AS DOUBLE) / 100.0 AS volume
       FROM live_lines WHERE ok AND NOT burning GROUP BY 1""",
)
def _(spark, sf_dir):
    return kept_daily_activity(spark, live_products(spark, sf_dir), 2)
