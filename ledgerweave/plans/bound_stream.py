"""Streaming and file queries. Streams read events copied to the shared folder in arrival slices."""

import uuid

from pyspark.sql import functions as F

from ledgerweave.functions import scalars as P
from ledgerweave.operators.addresses import address_tokens
from ledgerweave.operators.custody import RESTART
from ledgerweave.operators.state import latest_state
from ledgerweave.plans import views as V
from ledgerweave.plans.bound_events import matched, restart_calls
from ledgerweave.plans.bound_inbox import freeze_point
from ledgerweave.plans.registry import bound
from ledgerweave.session import shared_dir, spool
from ledgerweave.sources.files import read_csv_contract, read_document
from ledgerweave.sources.tables import commit_version, read_appended, read_latest
from ledgerweave.streaming.batches import finish, run_ledger, run_snapshot, stream_id
from ledgerweave.streaming.gate import PROVIDER, commit_gated, gate_rows, gated_stream
from ledgerweave.streaming.restarts import commit_restarts, restart_stream

SLICES = 3
FILES = 4  # files of a slice


def workspace(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def arrivals(spark, rows, order, path, shape=lambda rows: rows, source="off", files=FILES):
    """Write rows as ``SLICES`` slices of ``files`` files in order of arrival and read them back as a stream.

    ``shape`` makes wide rows of those that have been put in order. ``source``: what becomes of files that the stream has taken
    (``cleanSource``).
    """
    with spool(spark) as keep:
        held = keep(rows)
        bounds = held.agg(F.max(order).alias("top")).scalar()
        for i in range(SLICES):
            part = F.floor(F.col(order) * SLICES / (bounds + 1)) == i
            shape(held.filter(part).repartitionByRange(files, order)).write.mode("append").option("compression", "zstd").parquet(path)
    stream = spark.readStream.schema(shape(rows).schema).option("cleanSource", source)
    return stream.option("maxFilesPerTrigger", files).parquet(path)


@bound(
    "stream_snapshot",
    """SELECT 1::BIGINT AS turn, tx_id, seq, source FROM frozen UNION ALL
       SELECT 2::BIGINT, tx_id, seq, source FROM inbox
       WHERE status = 'pending' AND tx_id NOT IN (SELECT tx_id FROM frozen)""",
)
def _(spark, sf_dir):
    """One input, two instants: what is late for the first is in the second, nothing is in both."""
    home = workspace(spark, "snapshot")
    stream = arrivals(spark, V.inbox(spark, sf_dir), "seq", f"{home}/in")
    # The frozen instant is fixed before the stream starts, as one value.
    events = V.table(spark, sf_dir, "events")
    upto = events.filter(F.col("event_id") < V.edge(spark, sf_dir)).agg(F.max("ts")).first()[0]
    last = events.agg(F.max("ts")).first()[0]
    turns = [run_snapshot(stream, F.lit(instant), f"{home}/tables", f"{home}/checkpoint") for instant in (upto, last)]
    numbered = [t.select(F.lit(i).cast("bigint").alias("turn"), "tx_id", "seq", "source") for i, t in enumerate(turns, 1)]
    return numbered[0].unionByName(numbered[1])


@bound("stream_ledger", "SELECT tx_id, seq, source FROM inbox")
def _(spark, sf_dir):
    """Repeats inside a slice, and the whole input once more through a new checkpoint, change nothing."""
    home = workspace(spark, "ledger")
    rows = V.inbox(spark, sf_dir).select("tx_id", "seq", "source")
    first = rows.filter(F.col("seq") % 5 != 0)
    stream = arrivals(spark, first.unionByName(first.filter(F.col("seq") % 3 == 0)), "seq", f"{home}/first")
    finish(run_ledger(stream, f"{home}/tables", f"{home}/checkpoint-1", "tx_id", "seq"))
    again = arrivals(spark, rows, "seq", f"{home}/second")
    finish(run_ledger(again, f"{home}/tables", f"{home}/checkpoint-2", "tx_id", "seq"))
    return read_appended(spark, f"{home}/tables", "ledger")


def named_moves(spark, sf_dir):
    """Matched movements whose transaction ids are text."""
    return matched(spark, sf_dir).withColumn("tx", F.concat(F.lit("tx-"), F.col("tx").cast("string")))


def run_gate(spark, moves, activation, start=None):
    """All movements through the gate in slices by sequence number; returns the folder of the tables."""
    home = workspace(spark, "gate")
    # A session of its own: one state partition per core starts no idle workers, and the caller's settings stay.
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = gate_rows(moves, F.lit(activation))
    arrivals(spark, rows, "seq", f"{home}/in")
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{home}/in")
    checkpoint = f"{home}/checkpoint"

    def land(df, batch):
        commit_gated(df, f"{home}/tables", stream_id(df.sparkSession, checkpoint), batch)

    if start is not None:
        begin = f"{home}/start"
        start.write.parquet(begin)
        start = own.read.parquet(begin)
    query = gated_stream(stream, start).writeStream.foreachBatch(land).outputMode("update")
    finish(query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return f"{home}/tables"


@bound(
    "stream_state",
    """SELECT asset, 'tx-' || latest_tx AS tx, raw_owner, owner, custody_wallet, CAST(locked AS BIGINT) AS locked,
              CAST(burned AS BIGINT) AS burned FROM stated""",
)
def _(spark, sf_dir):
    """No cursors yet and an instant before all movements: every one applies."""
    first = V.table(spark, sf_dir, "events").agg(F.min("ts") - F.expr("interval 1 day")).first()[0]
    updates = read_appended(spark, run_gate(spark, named_moves(spark, sf_dir), first), "updates")
    fields = ["raw_owner", "owner", "custody_wallet", "locked", "burned"]
    last = updates.groupBy("asset").agg(F.max(F.struct("last_seq", "last_tx", *fields)).alias("_s"))
    return last.select("asset", F.col("_s.last_tx").alias("tx"), *[F.col(f"_s.{c}") for c in fields])


@bound("stream_statuses", "SELECT status, count(*) AS n FROM gated GROUP BY 1")
def _(spark, sf_dir):
    """Statuses of all micro-batches, from the committed cursors and states of the first half of the log."""
    moves = named_moves(spark, sf_dir)
    cut = V.table(spark, sf_dir, "events").agg(F.expr("(max(event_id) + 1) div 2")).first()[0]
    early = moves.filter(F.col("seq") < cut)
    activation = early.agg(F.max("ts")).first()[0]
    start = latest_state(early).join(early.groupBy("asset").agg(F.max("seq").alias("last_seq")), "asset").withColumn("last_tx", F.col("latest_tx"))
    tables = run_gate(spark, moves, activation, start.filter(F.col("asset") % 5 != 0))
    return read_appended(spark, tables, "statuses").groupBy("status").agg(F.sum("n").alias("n"))


@bound(
    "stream_restarts",
    """SELECT s.asset, 'tx-' || latest_tx AS tx, owner, CAST(locked AS BIGINT) AS locked, 'tx-' || a.tx AS activity_tx,
              strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS activity
       FROM stated s LEFT JOIN (SELECT asset, max(ts) AS ts, arg_max(tx, seq) AS tx FROM updates
                                WHERE e = 9223372036854775807 GROUP BY 1) a ON a.asset = s.asset""",
)
def _(spark, sf_dir):
    """Movements and restart calls of the whole log, sliced together, through both keyed operators."""
    home = workspace(spark, "restarts")
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    first = V.table(spark, sf_dir, "events").agg(F.min("ts") - F.expr("interval 1 day")).first()[0]
    rows = gate_rows(named_moves(spark, sf_dir), F.lit(first)).withColumn("action", F.lit(None).cast("string"))
    calls = restart_calls(spark, sf_dir).withColumns({"tx": F.concat(F.lit("tx-"), F.col("tx").cast("string")), "action": F.lit(RESTART)})
    log = rows.unionByName(calls, allowMissingColumns=True)
    arrivals(spark, log, "seq", f"{home}/in")
    # One folder read twice: each micro-batch has the movements and the calls of the same files.
    source = lambda: own.readStream.schema(log.schema).option("maxFilesPerTrigger", FILES).parquet(f"{home}/in")
    moved, asked = source().filter("action IS NULL").drop("ts", "action", "caller"), source().filter("action IS NOT NULL")
    checkpoint = f"{home}/checkpoint"

    def land(df, batch):
        commit_restarts(df, f"{home}/tables", stream_id(df.sparkSession, checkpoint), batch)

    query = restart_stream(moved, asked).writeStream.foreachBatch(land).outputMode("append")
    finish(query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    state = read_latest(spark, f"{home}/tables", "state")
    activity = F.date_format("activity_ts", "yyyy-MM-dd HH:mm:ss").alias("activity")
    return state.select("asset", F.col("latest_tx").alias("tx"), "owner", "locked", "activity_tx", activity)


@bound(
    "sorted_table",
    "SELECT asset, category, owner FROM state",
)
def _(spark, sf_dir):
    home = workspace(spark, "sorted")
    rows = V.state(spark, sf_dir).select("asset", "category", "owner")
    commit_version(spark, home, {"state": (rows, ["asset"])})
    return read_latest(spark, home, "state")


TEXTS = """
    SELECT c_custkey AS id,
           CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '<nil>' WHEN 2 THEN 'NULL' WHEN 3 THEN 'null'
                WHEN 4 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) || '.75' END AS raw FROM customer"""


def texts(spark, sf_dir):
    key = F.col("c_custkey")
    turn = key % 7
    raw = (
        F.when(turn == 0, "")
        .when(turn == 1, "<nil>")
        .when(turn == 2, "NULL")
        .when(turn == 3, "null")
        .when(turn == 4, F.concat(F.lit("x"), key.cast("string")))
        .otherwise(F.concat(key.cast("string"), F.lit(".75")))
    )
    return V.table(spark, sf_dir, "customer").select(key.alias("id"), raw.alias("raw"))


@bound(
    "scan_csv_contract",
    f"""SELECT CAST(id AS VARCHAR) AS id, raw, 'seg,"' || id || '"' AS note FROM ({TEXTS})""",
)
def _(spark, sf_dir):
    path = workspace(spark, "csv")
    rows = texts(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"),
        "raw",
        F.concat(F.lit('seg,"'), F.col("id").cast("string"), F.lit('"')).alias("note"),
    )
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return read_csv_contract(spark, path, "id string, raw string, note string")


CHECKPOINT_DOCUMENT = """
    schema_version int, cutover_date string, checkpoints struct<market:string,state:string>,
    reducer_counts map<string,bigint>, markets array<struct<name:string,sales:bigint>>
"""


@bound(
    "json_document",
    """SELECT 1 AS schema_version, (SELECT min(strftime(ts, '%Y-%m-%d')) FROM sales) AS cutover_date,
              (SELECT max(strftime(ts, '%Y-%m-%d')) FROM sales) AS market, (SELECT max(strftime(ts, '%Y-%m-%d')) FROM sales WHERE market = 'RF') AS state,
              (SELECT count(*) FROM sales WHERE market = 'RF') AS burns, market AS name, count(*) AS sales FROM sales GROUP BY market""",
)
def _(spark, sf_dir):
    """A checkpoint document with an object, a map and a list, written pretty and read back under its schema."""
    path = workspace(spark, "document")
    sales = V.sales(spark, sf_dir)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    burn = F.col("market") == "RF"
    markets = sales.groupBy(F.col("market").alias("name")).agg(F.count(F.lit(1)).alias("sales"))
    row = sales.agg(
        F.lit(1).alias("schema_version"),
        day(F.min("ts")).alias("cutover_date"),
        F.struct(day(F.max("ts")).alias("market"), day(F.max(F.when(burn, F.col("ts")))).alias("state")).alias("checkpoints"),
        F.create_map(F.lit("BURN"), F.count_if(burn)).alias("reducer_counts"),
    ).withColumn("markets", markets.agg(F.sort_array(F.collect_list(F.struct("name", "sales")))).scalar())  # one entry a market
    row.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    read = read_document(spark, path, CHECKPOINT_DOCUMENT)
    return read.select("schema_version", "cutover_date", "checkpoints.market", "checkpoints.state", F.col("reducer_counts")["BURN"].alias("burns"), F.inline("markets"))


@bound(
    "null_tokens",
    f"SELECT id, CASE WHEN raw NOT IN ('', '<nil>', 'NULL', 'null') THEN raw END AS value FROM ({TEXTS})",
)
def _(spark, sf_dir):
    return texts(spark, sf_dir).select("id", P.null_token(F.col("raw")).alias("value"))


@bound(
    "tolerant_cast",
    f"""SELECT id, CASE WHEN raw IN ('', '<nil>', 'NULL', 'null') THEN 0 ELSE CAST(floor(try_cast(raw AS DOUBLE)) AS BIGINT)
               END AS whole, CASE WHEN raw IN ('', '<nil>', 'NULL', 'null') THEN 0.0::DOUBLE ELSE try_cast(raw AS DOUBLE)
               END AS number, coalesce(CAST(floor(try_cast(raw AS DOUBLE)) AS BIGINT), 0) AS safe FROM ({TEXTS})""",
)
def _(spark, sf_dir):
    raw = F.col("raw")
    return texts(spark, sf_dir).select(
        "id",
        P.tolerant_long(raw).alias("whole"),
        P.tolerant_double(raw).alias("number"),
        P.long_or_zero(raw).alias("safe"),
    )


@bound(
    "duration_text",
    """WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE greatest(0, epoch_us((SELECT max(o_orderdate) FROM orders
                  WHERE o_orderkey % 2 = 0) - INTERVAL 100 DAY) - epoch_us(o_orderdate)) // 86400000000 END AS days FROM orders)
       SELECT id, CASE WHEN days IS NULL THEN '—' WHEN days < 60 THEN days || 'd'
              WHEN days < 730 THEN regexp_replace(CAST(CAST((days * 320 + 487) // 974 AS DECIMAL(18, 1)) / 10 AS DECIMAL(18, 1))::VARCHAR, '[.]0$', '') || 'mo'
              ELSE regexp_replace(CAST(CAST((days * 80 + 1461) // 2922 AS DECIMAL(18, 1)) / 10 AS DECIMAL(18, 1))::VARCHAR, '[.]0$', '') || 'y' END AS age FROM d""",
)
def _(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    end = orders.filter(F.col("o_orderkey") % 2 == 0).agg(F.max("o_orderdate") - F.expr("interval 100 days")).scalar()
    start = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return orders.withColumn("_end", end).select(F.col("o_orderkey").alias("id"), P.duration_text(F.col("_end"), start).alias("age"))


@bound(
    "parse_utc",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 < 5
              THEN strftime(o_orderdate + INTERVAL (CASE WHEN o_orderkey % 7 = 3 THEN 0 ELSE o_orderkey % 86400 END) SECOND,
                            '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM orders""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + key % 86400)
    turn = key % 7
    text = (
        F.when(turn == 0, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(".000 UTC")))
        .when(turn == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(turn == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
        .when(turn == 3, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(turn == 4, F.unix_seconds(at).cast("double").cast("string"))
        .when(turn == 5, F.lit("<nil>"))
    )
    rows = V.table(spark, sf_dir, "orders").select(key.alias("id"), text.alias("text"))
    return rows.select("id", P.iso_z(P.parse_utc(F.col("text"))).alias("utc"))


@bound(
    "address_quality",
    """WITH n AS (SELECT c_custkey AS id, 'B' || translate(CAST(c_custkey * 104729 + 17 AS VARCHAR), '0', 'z') AS seed FROM customer),
            t AS (SELECT id, repeat(seed, 8) AS long, seed FROM n),
            g AS (SELECT id, unnest([1, 2, 3, 4]) AS pos,
                         unnest([CASE WHEN id % 2 = 0 THEN repeat('1', 32) ELSE 'short' || id END,
                                 '0' || repeat('B', 35), repeat('1', 32), repeat('z', 45)]) AS token FROM t),
            v AS (SELECT id, pos, token, token = repeat('1', 32) AS valid,
                         row_number() OVER (PARTITION BY id, token ORDER BY pos) AS rn FROM g)
       SELECT id, token, valid FROM v WHERE NOT valid OR rn = 1""",
)
def _(spark, sf_dir):
    key = F.col("c_custkey")
    ones = F.repeat(F.lit("1"), F.lit(32))
    first = F.when(key % 2 == 0, ones).otherwise(F.concat(F.lit("short"), key.cast("string")))
    tokens = [first, F.concat(F.lit("0"), F.repeat(F.lit("B"), F.lit(35))), ones, F.repeat(F.lit("z"), F.lit(45))]
    text = F.concat(F.lit("  "), tokens[0], F.lit(", "), tokens[1], F.lit(";\n"), tokens[2], F.lit(" "), tokens[3])
    rows = V.table(spark, sf_dir, "customer").select(key.alias("id"), text.alias("text"))
    return address_tokens(rows, "id", "text").select("id", "token", "valid")
