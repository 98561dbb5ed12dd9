"""Inbox queries over the events table read as queue rows."""

from pyspark.sql import functions as F

from ledgerweave.operators import inbox as B
from ledgerweave.plans import views as V
from ledgerweave.plans.registry import bound

V.VIEWS["frozen"] = """
    SELECT * FROM inbox WHERE status = 'pending'
       AND received_at <= (SELECT max(ts) FROM events, edge WHERE event_id < cut)"""
HASH = """count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || ':' ||
          CAST(coalesce(sum(CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)), 0) AS VARCHAR) || ':' ||
          CAST(coalesce(sum(CAST('0x' || substr(md5({0}), 16, 15) AS BIGINT)), 0) AS VARCHAR)) AS content_hash"""


def ident(number):
    return F.concat(F.lit("event-"), F.lpad(number.cast("string"), 20, "0"))


def freeze_point(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    return events.filter(F.col("event_id") < V.edge(spark, sf_dir)).agg(F.max("ts")).scalar()


def frozen(spark, sf_dir):
    return B.frozen_snapshot(V.inbox(spark, sf_dir), freeze_point(spark, sf_dir))


@bound(
    "ingest_dedup",
    """SELECT 'event-' || lpad(CAST(event_id AS VARCHAR), 20, '0') AS tx_id, event_type AS source, event_id AS pos
       FROM events WHERE event_id % 4 <> 0""",
)
def _(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select(
        ident(F.col("event_id")).alias("tx_id"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("source"),
    )
    again = rows.filter(F.col("pos") % 3 == 0).withColumns({"pos": F.col("pos") + 1, "source": F.lit("repeat")})
    short = rows.withColumn("tx_id", F.lit("short"))
    have = rows.filter(F.col("pos") % 4 == 0)
    return B.ingest_new(rows.unionByName(again).unionByName(short), have).select("tx_id", "source", "pos")


@bound(
    "snapshot_keyset_page",
    """SELECT tx_id, strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') AS received_at FROM frozen
       WHERE (received_at, tx_id) > (SELECT (min(received_at), min(tx_id)) FROM frozen)
       ORDER BY received_at, tx_id LIMIT 100""",
)
def _(spark, sf_dir):
    snapshot = frozen(spark, sf_dir)
    cursor = snapshot.agg(F.min("received_at")).scalar(), snapshot.agg(F.min("tx_id")).scalar()
    page = B.keyset_page(snapshot, 100, cursor)
    return page.select("tx_id", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("received_at"))


@bound(
    "snapshot_rules",
    """SELECT count(*) AS n, count(DISTINCT tx_id) AS distinct_ids, count(*) FILTER (tx_id = '') AS blank_ids,
              count(*) = count(DISTINCT tx_id) AS ok FROM frozen""",
)
def _(spark, sf_dir):
    return B.snapshot_rules(frozen(spark, sf_dir))


@bound("cache_missing_keys", "SELECT DISTINCT tx FROM sale_lines WHERE tx % 4 = 0")
def _(spark, sf_dir):
    found = V.sale_lines(spark, sf_dir).select("tx")
    cached = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx")).filter(F.col("tx") % 4 != 0)
    return B.missing_keys(found, cached, "tx")


@bound(
    "ledger_exclude",
    """SELECT tx_id, seq % 6 <> 0 AS reduce, CASE WHEN seq % 6 = 0 THEN 'ALREADY_COMMITTED_LOCAL' END AS note FROM frozen""",
)
def _(spark, sf_dir):
    ledger = V.inbox(spark, sf_dir).filter(F.col("seq") % 6 == 0).select("tx_id")
    return B.exclude_ledgered(frozen(spark, sf_dir), ledger).select("tx_id", "reduce", "note")


@bound("ok_tx", "SELECT tx_id, source FROM inbox WHERE source <> 'error'")
def _(spark, sf_dir):
    err = F.when(F.col("source") == "error", F.lit("failed"))
    rows = V.inbox(spark, sf_dir).withColumn("err", err)
    return rows.filter(F.col("err").isNull()).select("tx_id", "source")


V.VIEWS["requested"] = """
    SELECT tx_id FROM inbox WHERE seq % 5 = 0
    UNION ALL SELECT 'event-' || lpad(CAST(seq + 100000000 AS VARCHAR), 20, '0') FROM inbox WHERE seq % 50 = 0
    UNION ALL SELECT tx_id FROM inbox WHERE seq % 10 = 0"""


def requested(spark, sf_dir):
    rows = V.inbox(spark, sf_dir)
    gone = rows.filter(F.col("seq") % 50 == 0).select(ident(F.col("seq") + 100000000).alias("tx_id"))
    again = rows.filter(F.col("seq") % 10 == 0).select("tx_id")
    return rows.filter(F.col("seq") % 5 == 0).select("tx_id").unionByName(gone).unionByName(again)


V.VIEWS["acked"] = """
    SELECT r.tx_id, CASE WHEN status IS NULL THEN 'missing' WHEN status IN ('pending', 'processed') THEN 'processed'
           ELSE 'not_processed' END AS outcome
    FROM (SELECT DISTINCT tx_id FROM requested) r LEFT JOIN inbox i ON i.tx_id = r.tx_id"""


@bound(
    "ack_reconcile",
    """SELECT count(*) AS requested, count(*) FILTER (outcome = 'processed') AS processed,
              count(*) FILTER (outcome = 'missing') AS missing,
              count(*) FILTER (outcome = 'not_processed') AS not_processed,
              count(*) = count(*) FILTER (outcome = 'processed') AS ok FROM acked""",
)
def _(spark, sf_dir):
    return B.ack_summary(B.acknowledge(requested(spark, sf_dir), V.inbox(spark, sf_dir)))


@bound("recover_batch", "SELECT tx_id, outcome FROM acked")
def _(spark, sf_dir):
    """The ids of a manifest, checked against its summary, and what the inbox says about each."""
    asked = requested(spark, sf_dir)
    return B.acknowledge(B.recover_batch(asked, B.batch_manifest(asked)), V.inbox(spark, sf_dir))


@bound("inbox_stats", "SELECT status, count(*) AS n FROM inbox GROUP BY 1")
def _(spark, sf_dir):
    return B.status_counts(V.inbox(spark, sf_dir))


@bound(
    "batch_manifest",
    f"""SELECT {HASH.format('tx_id')}, count(*) = count(DISTINCT tx_id) AS unique_ids,
               count(*) FILTER (tx_id = '') = 0 AS no_blank_ids FROM frozen""",
)
def _(spark, sf_dir):
    return B.batch_manifest(frozen(spark, sf_dir))


@bound(
    "heartbeat_upsert",
    "SELECT event_type AS pipeline, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_success_at FROM events GROUP BY 1",
)
def _(spark, sf_dir):
    beats = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("pipeline"), F.col("ts").alias("at"))
    text = F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return B.latest_heartbeat(beats).withColumn("last_success_at", text)


@bound(
    "freshness",
    """WITH u AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS live,
                         max(ts) FILTER (event_type = 'signup') AS daily, max(ts) FILTER (event_type = 'click') AS st,
                         max(ts) FILTER (event_type = 'view') AS fl FROM events GROUP BY 1),
            n AS (SELECT max(ts) AS now FROM events)
       SELECT user_id, CASE
            WHEN date_diff('day', CAST(st AS DATE), CAST(now + INTERVAL 26 DAY AS DATE)) > 30
                 AND date_diff('day', CAST(fl AS DATE), CAST(now + INTERVAL 26 DAY AS DATE)) > 30 THEN 'critical'
            WHEN now - live > INTERVAL 6 HOUR OR now - daily > INTERVAL 30 HOUR THEN 'warning' ELSE 'healthy' END AS tone
       FROM u, n""",
)
def _(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts").cast("timestamp")))
    seen = events.groupBy("user_id").agg(
        last("purchase").alias("live"), last("signup").alias("daily"), last("click").alias("st"), last("view").alias("fl")
    )
    now = events.agg(F.max("ts").cast("timestamp")).scalar()
    later = F.col("_now") + F.expr("interval 26 days")
    # Heartbeats are judged at the last event, data days 26 days after it.
    tone = B.freshness(F.col("_now"), F.col("live"), F.col("daily"), F.lit(None).cast("date"), F.lit(None).cast("date"))
    aged = B.freshness(later, F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), F.col("st"), F.col("fl"))
    rows = seen.withColumn("_now", now)
    return rows.select("user_id", F.when(aged == "critical", aged).otherwise(tone).alias("tone"))


@bound(
    "attempts",
    """WITH f AS (SELECT event_id - event_id % 3 AS seq, event_id AS at, 'e' || user_id AS error FROM events
                  WHERE event_type = 'error')
       SELECT i.tx_id, count(f.at) AS attempts, arg_max(f.error, f.at) AS last_error
       FROM inbox i LEFT JOIN f ON f.seq = i.seq WHERE status = 'pending' GROUP BY 1""",
)
def _(spark, sf_dir):
    seq = F.col("event_id")
    failures = (
        V.table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "error")
        .select(
            ident(seq - seq % 3).alias("tx_id"),
            F.col("ts").alias("failed_at"),
            F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("error"),
        )
    )
    return B.attempts(V.inbox(spark, sf_dir), failures)
