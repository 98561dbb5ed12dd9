"""Movement, call and state queries over the events table."""

from pyspark.sql import functions as F

from ledgerweave.functions.ordered import CHUNK, keep_last
from ledgerweave.operators import backtest as B
from ledgerweave.operators import custody as C
from ledgerweave.operators import restarts as X
from ledgerweave.operators import state as T
from ledgerweave.plans import views as V
from ledgerweave.plans.registry import bound
from ledgerweave.session import settled

# Call times are rounded to the hour, which makes ties, and some are set back three days.
V.VIEWS["restart_calls"] = """
    SELECT tx, seq, caller, date_trunc('hour', ts) - CASE WHEN tx % 97 = 0 THEN INTERVAL 3 DAY
           ELSE INTERVAL 0 DAY END AS ts
    FROM calls WHERE action = 'RESTART'"""
V.VIEWS["episodes"] = """
    SELECT asset, caller, ts AS lock_ts, seq AS s, n AS e FROM
      (SELECT *, coalesce(lead(seq) OVER (PARTITION BY asset ORDER BY seq), 9223372036854775807) AS n FROM matched)
    WHERE matched = 'LOCK'"""
V.VIEWS["updates"] = """
    SELECT * FROM (
      SELECT c.tx, c.seq, c.caller, c.ts, e.asset, e.s, e.e,
             max(c.ts) OVER (PARTITION BY e.asset, e.s ORDER BY c.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                 AS best
      FROM restart_calls c JOIN episodes e ON e.caller = c.caller AND c.seq > e.s AND c.seq < e.e AND c.ts >= e.lock_ts)
    WHERE best IS NULL OR ts > best"""
V.VIEWS["stated"] = """
    SELECT m.asset, CASE WHEN b.tx IS NULL THEN 0 ELSE 1 END AS burned, b.tx AS burn_tx, m.to_owner AS raw_owner,
           CASE WHEN matched = 'LOCK' THEN 1 ELSE 0 END AS locked,
           CASE WHEN matched = 'LOCK' THEN caller ELSE m.to_owner END AS owner,
           CASE WHEN matched = 'LOCK' THEN wallet END AS custody_wallet, m.tx AS latest_tx,
           CASE WHEN matched = 'LOCK' THEN m.tx END AS lock_tx
    FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY seq DESC) AS rn FROM matched) m
    LEFT JOIN (SELECT asset, max(tx) AS tx FROM matched WHERE class <> 'TRANSFER' GROUP BY 1) b ON b.asset = m.asset
    WHERE rn = 1"""
V.VIEWS["gated"] = """
    SELECT m.* EXCLUDE (act, opened),
           CASE WHEN c.asset IS NULL AND m.ts <= act AND coalesce(opened, 0) = 0
                     THEN 'COVERED_PRE_ACTIVATION' WHEN c.asset IS NULL THEN 'APPLY' WHEN m.seq < last_seq THEN 'STALE'
                     WHEN m.seq = last_seq THEN 'DUPLICATE' ELSE 'APPLY' END AS status
    FROM (SELECT *, max(CASE WHEN ts > act THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY seq, tx
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened
          FROM matched, (SELECT max(ts) AS act FROM moves, edge WHERE seq < cut)) m
    LEFT JOIN cursors c ON c.asset = m.asset"""


def restart_calls(spark, sf_dir):
    calls = V.calls(spark, sf_dir).filter(F.col("action") == C.RESTART)
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    back = F.when(F.col("tx") % 97 == 0, F.expr("interval 3 days")).otherwise(F.expr("interval 0 days"))
    return calls.select("tx", "seq", "caller", (hour - back).cast("timestamp_ntz").alias("ts"))


def matched(spark, sf_dir):
    return C.match_custody(V.moves(spark, sf_dir), V.calls(spark, sf_dir))


def gated(spark, sf_dir):
    moves = V.moves(spark, sf_dir)
    activation = moves.filter(F.col("seq") < V.edge(spark, sf_dir)).agg(F.max("ts")).scalar()
    return C.cursor_gate(matched(spark, sf_dir), V.cursors(spark, sf_dir), activation)


def walked(spark, sf_dir):
    asked, spans = X.walk(X.lock_episodes(matched(spark, sf_dir)), restart_calls(spark, sf_dir))
    return asked, spans, X.stray_updates(asked, spans)


@bound("cursor_gate", "SELECT tx, seq, asset, status FROM gated")
def _(spark, sf_dir):
    return gated(spark, sf_dir).select("tx", "seq", "asset", "status")


@bound("late_classes", "SELECT status, count(*) AS n FROM gated GROUP BY 1")
def _(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@bound("match_custody", "SELECT tx, asset, class, from_owner, to_owner, matched, caller, wallet FROM matched")
def _(spark, sf_dir):
    return matched(spark, sf_dir).select("tx", "asset", "class", "from_owner", "to_owner", "matched", "caller", "wallet")


@bound(
    "unmatched_calls",
    """SELECT c.tx, c.action, c.caller, c.wallet FROM calls c
       ANTI JOIN (SELECT * FROM matched WHERE matched IS NOT NULL) m ON m.tx = c.tx
       WHERE c.action IN ('LOCK', 'UNLOCK')""",
)
def _(spark, sf_dir):
    lone = C.unmatched_calls(V.calls(spark, sf_dir), matched(spark, sf_dir))
    return lone.select("tx", "action", "caller", "wallet")


@bound(
    "call_linked_assets",
    """SELECT c.tx, c.action, c.caller, coalesce(CAST(m.asset AS VARCHAR), '') AS assets
       FROM calls c LEFT JOIN (SELECT * FROM matched WHERE matched IS NOT NULL) m ON m.tx = c.tx""",
)
def _(spark, sf_dir):
    links = C.call_links(V.calls(spark, sf_dir), V.moves(spark, sf_dir))
    return links.select("tx", "action", "caller", F.array_join(F.col("assets").cast("array<string>"), "|").alias("assets"))


@bound(
    "action_usage",
    """SELECT c.action, count(*) AS calls, count(m.tx) AS linked_assets, count(DISTINCT c.caller) AS users
       FROM calls c LEFT JOIN (SELECT * FROM matched WHERE matched IS NOT NULL) m ON m.tx = c.tx GROUP BY 1""",
)
def _(spark, sf_dir):
    return C.action_usage(C.call_links(V.calls(spark, sf_dir), V.moves(spark, sf_dir)))


@bound(
    "sale_without_move",
    "SELECT tx, asset FROM sales s WHERE NOT EXISTS (SELECT 1 FROM sale_lines l WHERE l.tx = s.tx AND l.asset = s.asset AND l.market NOT LIKE 'R%')",
)
def _(spark, sf_dir):
    moved = V.sale_lines(spark, sf_dir).filter(~F.col("market").startswith("R"))
    return C.sales_by_movement(V.sales(spark, sf_dir), moved, moved=False).select("tx", "asset")


V.VIEWS["raw_moves"] = """
    SELECT event_id AS tx, k AS asset,
           CASE WHEN event_type <> 'error' THEN 'TRANSFER' WHEN value > 220 THEN 'BURN_OR_SEND_TO_ZERO'
                ELSE 'MINT_OR_RECEIVE_FROM_ZERO' END AS class, event_id % 2 = 0 AS burn_ok,
           CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'M'
                WHEN event_type = 'view' THEN 'W' || user_id ELSE 'U' || user_id END AS from_owner,
           CASE WHEN event_id % 11 = 0 OR event_type = 'error' THEN NULL
                WHEN event_type = 'signup' THEN 'W' || user_id ELSE 'U' || user_id END AS to_owner
    FROM ev WHERE event_type IN ('purchase', 'signup', 'view') OR (event_type = 'error' AND value > 200)"""
V.VIEWS["event_sales"] = "SELECT event_id AS tx, k + CASE WHEN event_id % 10 = 0 THEN 1000 ELSE 0 END AS asset FROM ev WHERE event_type = 'purchase' AND event_id % 2 = 0"


def raw_moves(spark, sf_dir):
    what, user, ident = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id")
    wallet, person = F.concat(F.lit("W"), user), F.concat(F.lit("U"), user)
    kept = V.ev(spark, sf_dir).filter(what.isin("purchase", "signup", "view") | ((what == "error") & (F.col("value") > 200)))
    return kept.select(
        ident.alias("tx"),
        F.col("k").alias("asset"),
        F.when(what != "error", C.TRANSFER).when(F.col("value") > 220, C.SENT).otherwise(C.RECEIVED).alias("class"),
        (ident % 2 == 0).alias("burn_ok"),
        F.when((what == "error") & (ident % 5 == 0), None)
        .when(what == "purchase", "M")
        .when(what == "view", wallet)
        .otherwise(person)
        .alias("from_owner"),
        F.when((ident % 11 == 0) | (what == "error"), None).when(what == "signup", wallet).otherwise(person).alias("to_owner"),
    )


def event_sales(spark, sf_dir):
    ident = F.col("event_id")
    bought = V.ev(spark, sf_dir).filter((F.col("event_type") == "purchase") & (ident % 2 == 0))
    return bought.select(ident.alias("tx"), (F.col("k") + F.when(ident % 10 == 0, 1000).otherwise(0)).alias("asset"))


@bound(
    "unresolved",
    """WITH m AS (SELECT r.*, s.tx IS NOT NULL AS sold FROM raw_moves r
                  LEFT JOIN event_sales s ON s.tx = r.tx AND s.asset = r.asset),
            ok AS (SELECT * FROM m WHERE class = 'TRANSFER' AND from_owner IS NOT NULL AND to_owner IS NOT NULL
                   AND (to_owner NOT IN ('U7', 'U8') OR sold)),
            hit AS (SELECT c.tx FROM calls c JOIN ok ON ok.tx = c.tx AND
                    ((c.action = 'LOCK' AND ok.to_owner = c.wallet AND ok.from_owner = c.caller) OR
                     (c.action = 'UNLOCK' AND ok.from_owner = c.wallet AND ok.to_owner = c.caller)))
       SELECT tx, CAST(asset AS VARCHAR) AS asset, reason FROM (
         SELECT tx, asset, CASE
             WHEN class = 'TRANSFER' AND (from_owner IS NULL OR to_owner IS NULL) THEN 'ambiguous transfer'
             WHEN class = 'TRANSFER' AND to_owner IN ('U7', 'U8') AND NOT sold THEN 'vault deposit without sale'
             WHEN class = 'BURN_OR_SEND_TO_ZERO' AND NOT burn_ok THEN 'sent without burn instruction'
             WHEN class = 'BURN_OR_SEND_TO_ZERO' AND from_owner IS NULL THEN 'ambiguous burn source'
             WHEN class = 'MINT_OR_RECEIVE_FROM_ZERO' THEN 'received from zero' END AS reason FROM m)
       WHERE reason IS NOT NULL
       UNION ALL SELECT tx, NULL, lower(action) || ' call without movement' FROM calls
                 WHERE action IN ('LOCK', 'UNLOCK') AND tx NOT IN (SELECT tx FROM hit)
       UNION ALL SELECT s.tx, CAST(s.asset AS VARCHAR), 'sale without movement' FROM event_sales s
                 ANTI JOIN raw_moves r ON r.tx = s.tx AND r.asset = s.asset""",
)
def _(spark, sf_dir):
    calls = V.calls(spark, sf_dir)
    moves = C.match_custody(raw_moves(spark, sf_dir), calls)
    return C.unresolved(moves, calls, event_sales(spark, sf_dir), vaults=["U7", "U8"])


@bound(
    "batch_counters",
    """SELECT 'MOVEMENT_' || status AS counter, count(*) AS n FROM gated GROUP BY 1
       UNION ALL SELECT 'CALL_' || action, count(*) FROM calls GROUP BY 1
       UNION ALL SELECT CASE class WHEN 'TRANSFER' THEN 'TRANSFER' ELSE 'BURN' END, count(*) FROM gated
                 WHERE status = 'APPLY' GROUP BY 1
       UNION ALL SELECT 'ASSET_' || matched, count(*) FROM gated WHERE status = 'APPLY' AND matched IS NOT NULL GROUP BY 1
       UNION ALL SELECT 'SALE', count(*) FROM event_sales""",
)
def _(spark, sf_dir):
    return C.batch_counters(gated(spark, sf_dir), V.calls(spark, sf_dir), event_sales(spark, sf_dir))


@bound(
    "overlap_replay",
    """SELECT DISTINCT tx, asset, class FROM moves
       WHERE ts > (SELECT max(m.ts) FROM moves m, edge WHERE m.seq < cut)""",
)
def _(spark, sf_dir):
    moves = V.moves(spark, sf_dir)
    twice = moves.unionByName(moves.filter(F.col("asset") % 3 == 0))
    checkpoint = moves.filter(F.col("seq") < V.edge(spark, sf_dir)).agg(F.max("ts")).scalar()
    keys = ["tx", "asset", "class", "from_owner", "to_owner"]
    return C.overlap_replay(twice, checkpoint, keys, ["seq"]).select("tx", "asset", "class")


STATE = ["asset", "burned", "burn_tx", "raw_owner", "locked", "owner", "custody_wallet", "latest_tx", "lock_tx"]


@bound("latest_state", "SELECT * FROM stated")
def _(spark, sf_dir):
    return T.latest_state(matched(spark, sf_dir)).select(*STATE)


@bound(
    "running_record",
    """SELECT tx, caller, best IS NULL OR ts > best AS record
       FROM (SELECT *, max(ts) OVER (PARTITION BY caller ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             AS best FROM restart_calls)""",
)
def _(spark, sf_dir):
    rows = T.running_record(restart_calls(spark, sf_dir), ["caller"], ["seq", "tx"], "ts", F.expr(f"seq div {CHUNK}"))
    return rows.select("tx", "caller", "record")


@bound(
    "restart_fanout",
    """SELECT asset, s AS start_seq, any_value(caller) AS user, count(*) AS updates,
              strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS activity, arg_max(tx, seq) AS activity_tx
       FROM updates GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    rows = X.restart_fanout(*walked(spark, sf_dir))
    return rows.select(
        "asset",
        "start_seq",
        "user",
        F.col("updates").cast("bigint").alias("updates"),
        F.date_format("activity_ts", "yyyy-MM-dd HH:mm:ss").alias("activity"),
        "activity_tx",
    )


@bound(
    "restart_effects",
    """SELECT c.tx, c.caller AS user, count(u.asset) AS assets_changed
       FROM restart_calls c LEFT JOIN updates u ON u.tx = c.tx GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return X.restart_effects(*walked(spark, sf_dir)).select("tx", "user", "assets_changed")


V.VIEWS["touches"] = """
    SELECT asset, from_owner AS account, ts, seq, 0 AS flag FROM moves WHERE from_owner IS DISTINCT FROM to_owner
    UNION ALL SELECT asset, to_owner, ts, seq, 1 FROM moves
              WHERE from_owner IS DISTINCT FROM to_owner AND to_owner IS NOT NULL
    UNION ALL SELECT DISTINCT asset, 'M', TIMESTAMP '2023-12-31', -1, 1 FROM moves"""


def account_base(spark, sf_dir):
    start = F.lit("2023-12-31").cast("timestamp_ntz")
    return V.moves(spark, sf_dir).select("asset").distinct().select(
        "asset", F.lit("M").alias("account"), start.alias("first_ts"), start.alias("last_ts"), F.lit(1).alias("is_current")
    )


def account_moves(spark, sf_dir):
    return V.moves(spark, sf_dir).select(
        "tx", "seq", "ts", "asset", F.col("from_owner").alias("before"), F.col("to_owner").alias("after")
    )


@bound(
    "account_scd",
    """SELECT asset, account, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
              strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, CAST(arg_max(flag, seq) AS BIGINT) AS is_current
       FROM touches GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    rows = T.account_history(account_base(spark, sf_dir), account_moves(spark, sf_dir))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select("asset", "account", text("first_ts").alias("first_seen"), text("last_ts").alias("last_seen"), "is_current")


@bound(
    "introduced_accounts",
    """SELECT account, arg_min(asset, seq) AS asset, min(seq) AS first_tx FROM touches
       WHERE account <> 'M' GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = T.introduced_accounts(account_base(spark, sf_dir), account_moves(spark, sf_dir))
    return rows.select("account", "asset", "first_tx")


@bound(
    "replay_equal",
    "SELECT count(*) AS states, 0::BIGINT AS only_a, 0::BIGINT AS only_b, true AS equal FROM stated",
)
def _(spark, sf_dir):
    log = matched(spark, sf_dir)
    a = T.latest_state(log)
    # Second reduction: the first half of the log, then the second half over it.
    cut = V.edge(spark, sf_dir)
    early, late = T.latest_state(log.filter(F.col("seq") < cut)), T.latest_state(log.filter(F.col("seq") >= cut))
    fresh = late.join(early.select("asset"), "asset", "left_anti")
    b = T.merge_state(early, late).unionByName(fresh)
    return T.replay_equal(a, b).select((F.col("rows_seen") / 2).cast("bigint").alias("states"), "only_a", "only_b", "equal")


@bound(
    "state_backtest",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY seq DESC) AS rn FROM matched),
            b AS (SELECT asset, max(tx) AS base_tx FROM matched, edge WHERE seq < cut GROUP BY 1)
       SELECT l.asset, CASE WHEN class <> 'TRANSFER' THEN 'BURN' ELSE coalesce(matched, 'TRANSFER') END AS class,
              CASE WHEN l.asset % 9 = 0 THEN 'raw_owner' ELSE '' END AS mismatched, l.asset % 9 <> 0 AS passed
       FROM l LEFT JOIN b ON b.asset = l.asset WHERE rn = 1 AND l.tx IS DISTINCT FROM base_tx""",
)
def _(spark, sf_dir):
    log = matched(spark, sf_dir)
    base = T.latest_state(log.filter(F.col("seq") < V.edge(spark, sf_dir)))
    stored = T.latest_state(log).withColumn(
        "raw_owner", F.when(F.col("asset") % 9 == 0, "someone else").otherwise(F.col("raw_owner"))
    )
    return T.state_backtest(stored, base, keep_last(log, ["asset"], ["seq", "tx"]))


# Every stored state after the whole log with restarts, and faults in it by asset number.
V.VIEWS["stored"] = """
    SELECT s.*, l.ts AS latest_ts, a.ts AS activity_ts, a.tx AS activity_tx,
           CASE WHEN s.asset % 7 = 0 THEN 'someone' WHEN s.locked = 1 THEN s.owner END AS lock_user, b.raw_owner AS base_owner,
           coalesce(b.burned, 0) AS base_burned, coalesce(b.locked, 0) AS base_locked, b.lock_tx AS base_lock, b.latest_tx AS base_tx
    FROM stated s JOIN matched l ON l.tx = s.latest_tx
    LEFT JOIN (SELECT asset, max(ts) AS ts, arg_max(tx, seq) AS tx FROM updates WHERE e = 9223372036854775807 GROUP BY 1) a ON a.asset = s.asset
    LEFT JOIN stated_base b ON b.asset = s.asset"""
V.VIEWS["matched_base"] = "SELECT m.* FROM matched m, edge WHERE seq < cut"
V.VIEWS["stated_base"] = V.VIEWS["stated"].replace("matched)", "matched_base)").replace("FROM matched WHERE", "FROM matched_base WHERE")
V.VIEWS["backtest"] = """
    SELECT class, asset, tx, coalesce(mismatched, '') AS mismatched FROM (
    SELECT 'LOCK' AS class, asset, lock_tx AS tx, concat_ws('|', CASE WHEN asset % 11 = 0 THEN 'owner' END, CASE WHEN asset % 7 = 0 THEN 'lock_user' END) AS mismatched
    FROM stored WHERE locked = 1 AND lock_tx IS DISTINCT FROM base_lock
    UNION ALL SELECT 'RESTART', asset, activity_tx, CASE WHEN asset % 7 = 0 THEN 'missing event' WHEN asset % 5 = 0 THEN 'activity_ts' ELSE '' END
    FROM (SELECT * FROM stored WHERE locked = 1 AND activity_tx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY activity_tx ORDER BY asset) = 1)
    UNION ALL SELECT 'BURN', asset, burn_tx, concat_ws('|', CASE WHEN asset % 11 = 0 THEN 'owner' END, CASE WHEN latest_tx <> burn_tx THEN 'moved' END,
                                                     CASE WHEN asset % 9 = 0 THEN 'burn_ts' END, CASE WHEN asset % 7 = 0 THEN 'lock_user' END)
    FROM stored WHERE burned = 1 AND base_burned = 0
    UNION ALL SELECT CASE WHEN m.matched = 'UNLOCK' THEN 'UNLOCK' ELSE 'TRANSFER' END, s.asset, latest_tx,
                     concat_ws('|', CASE WHEN s.asset % 11 = 0 THEN 'owner' END, CASE WHEN s.asset % 7 = 0 THEN 'lock_user' END)
    FROM stored s JOIN matched m ON m.tx = s.latest_tx
    WHERE burned = 0 AND base_burned = 0 AND locked = 0 AND latest_tx IS DISTINCT FROM base_tx
      AND (base_locked = 1 OR raw_owner IS DISTINCT FROM base_owner))"""


def backtested(spark, sf_dir, newest):
    """The backtest over a stored state with faults in owner, lock, burn and activity fields."""
    log = settled(matched(spark, sf_dir))
    base = T.latest_state(log.filter(F.col("seq") < V.edge(spark, sf_dir)))
    asked, spans, odd = walked(spark, sf_dir)
    after = X.apply_restarts(T.latest_state(log), X.restart_fanout(asked, spans, odd), T.ACTIVITY_SOURCE, T.ACTIVITY_DEPTH)
    key, hour = F.col("asset"), F.expr("interval 1 hour")
    stored = after.withColumns(
        {
            "owner": F.when(key % 11 == 0, "someone else").otherwise(F.col("owner")),
            "lock_user": F.when(key % 7 == 0, "someone").otherwise(F.col("lock_user")),
            "burn_ts": F.when(key % 9 == 0, F.col("burn_ts") + hour).otherwise(F.col("burn_ts")),
            "activity_ts": F.when((key % 5 == 0) & F.col("activity_ts").isNotNull(), F.col("activity_ts") + hour).otherwise(F.col("activity_ts")),
        }
    )
    calls = restart_calls(spark, sf_dir).withColumn("action", F.lit(C.RESTART))
    return B.backtest_by_class(settled(stored), settled(base), log, calls, newest)


@bound(
    "backtest_classes",
    """SELECT class, asset, tx, CASE WHEN contains(mismatched, 'moved') THEN NULL ELSE mismatched END AS mismatched,
              CASE WHEN contains(mismatched, 'moved') THEN NULL ELSE mismatched = '' END AS passed FROM backtest""",
)
def _(spark, sf_dir):
    """Every case of all five classes; what an asset did after its burn is left open."""
    rows = backtested(spark, sf_dir, None)
    later = F.col("mismatched").contains("latest_tx") & (F.col("class") == "BURN")
    return rows.withColumns({"mismatched": F.when(~later, F.col("mismatched")), "passed": F.when(~later, F.col("passed"))})


@bound(
    "backtest_report",
    """WITH ranked AS (
         SELECT b.*, row_number() OVER (PARTITION BY CASE WHEN b.class IN ('TRANSFER', 'UNLOCK') THEN 'MOVED' ELSE b.class END ORDER BY
                CASE b.class WHEN 'RESTART' THEN s.activity_ts + CASE WHEN b.asset % 5 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END
                           WHEN 'BURN' THEN m.ts + CASE WHEN b.asset % 9 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END
                           ELSE m.ts END DESC, b.tx DESC, b.asset) AS n
         FROM backtest b JOIN stored s ON s.asset = b.asset LEFT JOIN matched m ON m.tx = b.tx)
       SELECT class, count(*) FILTER (WHERE mismatched = '') AS passed, count(*) FILTER (WHERE mismatched <> '') AS failed
       FROM ranked WHERE n <= 12 GROUP BY 1""",
)
def _(spark, sf_dir):
    """The twelve newest cases of each class."""
    return B.backtest_report(backtested(spark, sf_dir, 12))
