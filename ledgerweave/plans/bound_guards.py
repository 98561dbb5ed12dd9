"""Guards, each over an input that holds violations: what they let pass and what they report."""

from pyspark.sql import functions as F

from ledgerweave.operators import holders as H
from ledgerweave.operators import inbox as B
from ledgerweave.operators import overlay as O
from ledgerweave.operators import quality as Q
from ledgerweave.operators import reconcile as R
from ledgerweave.operators import series as S
from ledgerweave.operators import state as T
from ledgerweave.operators import wallets as W
from ledgerweave.plans import bound_events as E
from ledgerweave.plans import bound_reconcile as C
from ledgerweave.plans import bound_wallets as P
from ledgerweave.plans import views as V
from ledgerweave.plans.bound_state import mints
from ledgerweave.plans.registry import bound


@bound("overlay_unknown_keys", "SELECT asset FROM delta WHERE asset % 7 = 3")
def _(spark, sf_dir):
    """Delta rows for assets that a base without every seventh one does not know."""
    base = C.cust(spark, sf_dir).filter(F.col("asset") % 7 != 3)
    return O.unknown_keys(C.delta(spark, sf_dir), base, "asset")


@bound(
    "change_counts",
    """SELECT f.field, count(*) AS changes FROM cust c JOIN overlaid o ON o.asset = c.asset,
              LATERAL (VALUES ('balance', CAST(c.balance AS VARCHAR), CAST(o.balance AS VARCHAR)),
                              ('segment', c.segment, o.segment)) f(field, before, after)
       WHERE f.before IS DISTINCT FROM f.after GROUP BY 1""",
)
def _(spark, sf_dir):
    before = C.cust(spark, sf_dir)
    after = O.overlay_full(before, C.delta(spark, sf_dir), "asset", C.FIELDS)
    return O.change_counts(O.field_changes(before, after, "asset", C.FIELDS))


@bound(
    "account_conflicts",
    """SELECT asset, CAST(sum(is_current) AS BIGINT) AS current FROM
         (SELECT asset, account, arg_max(flag, seq) AS is_current FROM touches GROUP BY 1, 2)
       GROUP BY 1 HAVING sum(is_current) > 1""",
)
def _(spark, sf_dir):
    """Movements of the events table do not follow each other, so assets end with several current accounts."""
    return T.current_conflicts(T.account_history(E.account_base(spark, sf_dir), E.account_moves(spark, sf_dir)))


@bound(
    "gap_budget",
    """WITH p AS (SELECT count(*) AS n FROM gaps g ANTI JOIN (SELECT * FROM audits WHERE complete = 1) a ON a.asset = g.asset
                  AND a.account = g.account AND a.chain_owner = g.chain_owner AND a.state_owner = g.state_owner)
       SELECT n AS pending, n <= 1000000000 AS within_cap, 1000000000::BIGINT AS cap FROM p
       UNION ALL SELECT n, n <= 0, 0 FROM p""",
)
def _(spark, sf_dir):
    found = C.gaps(spark, sf_dir)
    pending = R.pending_gaps(found, C.audits(found))
    caps = [R.gap_budget(pending, cap).withColumn("cap", F.lit(cap).cast("bigint")) for cap in (1_000_000_000, 0)]
    return caps[0].unionByName(caps[1])


@bound(
    "cache_upsert",
    """SELECT asset, balance, segment FROM cust WHERE asset % 4 <> 0 AND asset % 5 <> 0
       UNION ALL SELECT asset, balance, segment FROM delta""",
)
def _(spark, sf_dir):
    """Cached rows, some replaced by fresh ones; fresh rows that the cache lacks are inserted."""
    names = ["asset", "balance", "segment"]
    cached = C.cust(spark, sf_dir).filter(F.col("asset") % 4 != 0).select(*names)
    return B.upsert(cached, C.delta(spark, sf_dir).select(*names), "asset")


@bound("active_owners", "SELECT DISTINCT owner FROM state WHERE burned = 0 AND owner IS NOT NULL")
def _(spark, sf_dir):
    return H.active_owners(V.state(spark, sf_dir))


@bound(
    "timeline_page",
    """SELECT set_id, kind, strftime(ts, '%Y-%m-%d') AS date, asset, idx FROM resales
       WHERE kind = 'buy' AND set_id = (SELECT min(set_id) FROM resales WHERE kind = 'buy')
       ORDER BY ts DESC, idx LIMIT 5""",
)
def _(spark, sf_dir):
    """The newest five purchases of the first set that has any."""
    rows = W.timeline(W.mint_index(mints(spark, sf_dir)), W.match_resales(P.trades(spark, sf_dir)), P.sets(spark, sf_dir))
    first = rows.filter(F.col("kind") == "buy").agg(F.min("set_id")).scalar()
    page = W.timeline_page(rows, first, 5, "buy")
    return page.select("set_id", "kind", F.date_format("ts", "yyyy-MM-dd").alias("date"), "asset", "idx")


@bound(
    "dq_falls_found",
    """WITH m AS (SELECT strftime(ts, '%Y-%m-01') AS month, count(*) AS sales FROM sales GROUP BY 1),
            p AS (SELECT month, sales, lag(sales) OVER (ORDER BY month) AS before FROM m)
       SELECT count(*) AS n, count(*) FILTER (sales < before) AS falls, count(*) FILTER (sales < before) = 0 AS ok FROM p""",
)
def _(spark, sf_dir):
    """The same rule over monthly counts, which do fall, instead of running totals."""
    monthly = V.sales(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-01").alias("month"))
    return Q.non_decreasing(monthly.agg(F.count(F.lit(1)).alias("sales")), "month", "sales")


@bound(
    "replay_unequal",
    """SELECT count(*) FILTER (asset % 6 = 0) AS only_a, count(*) FILTER (asset % 6 = 0) AS only_b,
              count(*) FILTER (asset % 6 = 0) = 0 AS equal FROM stated""",
)
def _(spark, sf_dir):
    """Every sixth state of the second reduction has lost its owner."""
    states = T.latest_state(E.matched(spark, sf_dir))
    hit = F.col("asset") % 6 == 0
    other = states.withColumn("latest_tx", F.when(hit, -F.col("latest_tx") - 1).otherwise(F.col("latest_tx")))
    return T.replay_equal(states, other).select("only_a", "only_b", "equal")


@bound(
    "dq_rules_broken",
    """WITH s AS (SELECT count(*) FILTER (burned = 1) AS burned, count(*) FILTER (locked = 1) AS locked FROM state)
       SELECT 'bucket sum = locked' AS rule, CAST(locked AS DOUBLE) AS left, CAST(locked AS DOUBLE) + 1 AS right, false AS ok FROM s
       UNION ALL SELECT 'burn history end = burned', burned, burned - 1, false FROM s""",
)
def _(spark, sf_dir):
    """Consistency rules over published figures that are off by one."""
    states, as_of = V.state(spark, sf_dir), V.clock(spark, sf_dir)
    kpi = H.state_kpis(states, as_of)
    rules = [
        ("bucket sum = locked", Q.scalar(H.activity_buckets(states, as_of), F.sum("assets")), Q.scalar(kpi, F.max("locked_assets") + 1), 0),
        ("burn history end = burned", Q.scalar(S.burn_history(states, as_of), F.max("total_burns")), Q.scalar(kpi, F.max("burned") - 1), 0),
    ]
    return Q.rule_report(spark, rules)


@bound(
    "allowed_changes_report",
    """WITH x AS (SELECT d.asset, d.balance IS DISTINCT FROM c.balance AS b, d.segment IS DISTINCT FROM c.segment AS s
                  FROM delta d JOIN cust c ON c.asset = d.asset),
            v AS (SELECT CASE WHEN NOT b AND NOT s THEN 'no-op' WHEN s THEN 'forbidden' ELSE 'ok' END AS verdict, count(*) AS found FROM x GROUP BY 1)
       SELECT verdict, found, CASE WHEN verdict = 'ok' THEN found + 1 ELSE found END AS reported, verdict <> 'ok' AS ok FROM v
       UNION ALL SELECT 'unheard', NULL, 3, false""",
)
def _(spark, sf_dir):
    """A report that is off by one in one verdict and has another that nothing falls under."""
    verdicts = O.allowed_changes(C.cust(spark, sf_dir), C.delta(spark, sf_dir), "asset", C.FIELDS, ["balance"])
    counts = verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    stated = counts.withColumn("n", F.when(F.col("verdict") == "ok", F.col("n") + 1).otherwise(F.col("n")))
    extra = spark.range(1).select(F.lit("unheard").alias("verdict"), F.lit(3).cast("bigint").alias("n"))
    return O.report_matches(verdicts, stated.unionByName(extra))
