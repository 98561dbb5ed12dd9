"""Overlay, reconcile and set queries over the test tables."""

import uuid

from pyspark.sql import functions as F

from ledgerweave.functions.ordered import keep_last
from ledgerweave.operators import overlay as O
from ledgerweave.operators import reconcile as R
from ledgerweave.operators import sets as U
from ledgerweave.plans import views as V
from ledgerweave.plans.registry import bound
from ledgerweave.session import shared_dir
from ledgerweave.sources.digests import version_changes, write_digested

FIELDS = ["balance", "segment", "nation"]

V.VIEWS["cust"] = """
    SELECT c_custkey AS asset, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, c_mktsegment AS segment,
           CAST(c_nationkey AS BIGINT) AS nation FROM customer"""
V.VIEWS["delta"] = """
    SELECT asset, CASE WHEN asset % 10 = 0 THEN NULL WHEN asset % 10 = 5 AND asset % 4 = 1 THEN balance
                       ELSE balance + 1 END AS balance,
           CASE WHEN asset % 15 = 0 THEN 'CHANGED' ELSE segment END AS segment, nation
    FROM cust WHERE asset % 5 = 0"""
V.VIEWS["overlaid"] = """
    SELECT c.asset, CASE WHEN d.asset IS NOT NULL THEN d.balance ELSE c.balance END AS balance,
           CASE WHEN d.asset IS NOT NULL THEN d.segment ELSE c.segment END AS segment,
           CASE WHEN d.asset IS NOT NULL THEN d.nation ELSE c.nation END AS nation
    FROM cust c LEFT JOIN delta d ON d.asset = c.asset"""
for _name, _cut in [("snap_a", "1998-07-01"), ("snap_b", "2001-01-01")]:
    V.VIEWS[_name] = f"""
        SELECT asset, CAST(CASE WHEN market = 'RF' THEN 1 ELSE 0 END AS BIGINT) AS burned,
               CASE WHEN market <> 'RF' AND buyer % 50 <> 7 THEN 'W' || buyer END AS owner,
               'A' || asset || '-' || buyer AS account
        FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, tx DESC) AS rn FROM sales
              WHERE ts < TIMESTAMP '{_cut}') WHERE rn = 1"""
V.VIEWS["evidence"] = """
    SELECT k.asset, CASE WHEN h.asset IS NOT NULL THEN 0 ELSE s.burned END AS supply_zero,
           CASE WHEN h.asset IS NOT NULL THEN h.owner ELSE s.owner END AS chain_owner,
           CASE WHEN h.asset IS NOT NULL THEN h.account ELSE s.account END AS account,
           CASE WHEN h.asset IS NOT NULL THEN 'holdings' WHEN s.asset IS NOT NULL THEN 'snapshot' ELSE 'none' END AS source
    FROM snap_a k
    LEFT JOIN (SELECT * FROM snap_b WHERE owner IS NOT NULL AND asset % 3 <> 0) h ON h.asset = k.asset
    LEFT JOIN (SELECT * FROM snap_b WHERE asset % 7 <> 0) s ON s.asset = k.asset"""
V.VIEWS["recon"] = """
    SELECT e.asset, e.account, e.chain_owner, a.owner AS state_owner,
           CASE WHEN source = 'none' THEN 'no_evidence' WHEN supply_zero = 1 AND burned = 0 THEN 'missing_burn'
                WHEN supply_zero = 1 THEN 'agree' WHEN burned = 1 THEN 'false_burn'
                WHEN chain_owner IS NULL THEN 'owner_missing'
                WHEN chain_owner <> coalesce(a.owner, '') THEN 'owner_gap' ELSE 'agree' END AS status
    FROM evidence e JOIN snap_a a ON a.asset = e.asset"""
V.VIEWS["gaps"] = """
    SELECT asset, account, chain_owner, coalesce(state_owner, '') AS state_owner FROM recon
    WHERE status = 'owner_gap'"""
V.VIEWS["audits"] = """
    SELECT asset, account, CASE WHEN asset % 4 = 0 THEN chain_owner || 'x' ELSE chain_owner END AS chain_owner,
           state_owner, CASE WHEN asset % 5 = 0 THEN 0 ELSE 1 END AS complete, asset % 3 AS later FROM gaps"""


def cust(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("asset"),
        V.cents("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("bigint").alias("nation"),
    )


def delta(spark, sf_dir):
    a = F.col("asset")
    same = (a % 10 == 5) & (a % 4 == 1)
    return (
        cust(spark, sf_dir)
        .filter(a % 5 == 0)
        .withColumn("balance", F.when(a % 10 != 0, F.when(same, F.col("balance")).otherwise(F.col("balance") + 1)))
        .withColumn("segment", F.when(a % 15 == 0, "CHANGED").otherwise(F.col("segment")))
    )


def snap(spark, sf_dir, cut):
    early = V.sales(spark, sf_dir, F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    last = keep_last(early.select("asset", "ts", "tx", "buyer", "market"), ["asset"], ["ts", "tx"])
    burned = F.col("market") == "RF"
    return last.select(
        "asset",
        F.when(burned, 1).otherwise(0).cast("bigint").alias("burned"),
        F.when(~burned & (F.col("buyer") % 50 != 7), F.concat(F.lit("W"), F.col("buyer").cast("string"))).alias("owner"),
        F.concat_ws("-", F.concat(F.lit("A"), F.col("asset").cast("string")), F.col("buyer").cast("string")).alias("account"),
    )


def snap_a(spark, sf_dir):
    return snap(spark, sf_dir, "1998-07-01")


def snap_b(spark, sf_dir):
    return snap(spark, sf_dir, "2001-01-01")


def evidence(spark, sf_dir):
    now = snap_b(spark, sf_dir)
    held = now.filter(F.col("owner").isNotNull() & (F.col("asset") % 3 != 0))
    seen = now.select(
        "asset",
        F.col("burned").alias("supply_zero"),
        "owner",
        "account",
        F.when(F.col("asset") % 7 == 0, 0).otherwise(1).alias("complete"),
    )
    return R.evidence_priority(snap_a(spark, sf_dir).select("asset"), held, seen)


def recon(spark, sf_dir):
    return R.reconcile_state(snap_a(spark, sf_dir), evidence(spark, sf_dir))


def gaps(spark, sf_dir):
    rows = recon(spark, sf_dir).filter(F.col("status") == "owner_gap")
    return rows.select("asset", "account", "chain_owner", F.coalesce("state_owner", F.lit("")).alias("state_owner"))


def audits(found):
    a = F.col("asset")
    return found.select(
        "asset",
        "account",
        F.when(a % 4 == 0, F.concat("chain_owner", F.lit("x"))).otherwise(F.col("chain_owner")).alias("chain_owner"),
        "state_owner",
        F.when(a % 5 == 0, 0).otherwise(1).alias("complete"),
        (a % 3).alias("later"),
    )


@bound("overlay_full", "SELECT asset, balance, segment, nation FROM overlaid")
def _(spark, sf_dir):
    return O.overlay_full(cust(spark, sf_dir), delta(spark, sf_dir), "asset", FIELDS)


@bound(
    "overlay_nonblank",
    """SELECT c.asset, c.balance, coalesce(nullif(trim(d.mark), ''), c.segment) AS segment, c.nation
       FROM cust c LEFT JOIN (SELECT asset, CASE asset % 15 WHEN 0 THEN 'CHANGED' WHEN 5 THEN ' ' END AS mark FROM delta) d
       ON d.asset = c.asset""",
)
def _(spark, sf_dir):
    a = F.col("asset")
    sparse = delta(spark, sf_dir).select(
        "asset", F.when(a % 15 == 0, "CHANGED").when(a % 15 == 5, " ").alias("segment")
    )
    return O.overlay_nonblank(cust(spark, sf_dir), sparse, "asset", ["segment"])


@bound(
    "state_diff",
    """SELECT c.asset, f.field, f.before, f.after FROM cust c JOIN overlaid o ON o.asset = c.asset,
              LATERAL (VALUES ('balance', CAST(c.balance AS VARCHAR), CAST(o.balance AS VARCHAR)),
                              ('segment', c.segment, o.segment),
                              ('nation', CAST(c.nation AS VARCHAR), CAST(o.nation AS VARCHAR))) f(field, before, after)
       WHERE f.before IS DISTINCT FROM f.after""",
)
def _(spark, sf_dir):
    before = cust(spark, sf_dir)
    after = O.overlay_full(before, delta(spark, sf_dir), "asset", FIELDS)
    return O.field_changes(before, after, "asset", FIELDS)


@bound(
    "allowed_changes",
    """WITH x AS (SELECT d.asset, d.balance IS DISTINCT FROM c.balance AS b, d.segment IS DISTINCT FROM c.segment AS s
                  FROM delta d JOIN cust c ON c.asset = d.asset)
       SELECT asset, concat_ws('|', CASE WHEN b THEN 'balance' END, CASE WHEN s THEN 'segment' END) AS changed,
              CASE WHEN s THEN 'segment' ELSE '' END AS forbidden,
              CASE WHEN NOT b AND NOT s THEN 'no-op' WHEN s THEN 'forbidden' ELSE 'ok' END AS verdict FROM x""",
)
def _(spark, sf_dir):
    return O.allowed_changes(cust(spark, sf_dir), delta(spark, sf_dir), "asset", FIELDS, ["balance"])


@bound(
    "snapshot_diff",
    """WITH j AS (SELECT coalesce(a.asset, b.asset) AS asset, a.asset IS NULL AS na, b.asset IS NULL AS nb,
                         a.burned AS was, b.burned AS now, a.owner AS old_owner,
                         CASE WHEN b.burned = 0 THEN b.owner END AS new_owner
                  FROM snap_a a FULL JOIN snap_b b ON a.asset = b.asset)
       SELECT asset, old_owner, new_owner, 'new_burn' AS class FROM j WHERE was = 0 AND now = 1
       UNION ALL SELECT asset, old_owner, new_owner, 'burn_regression' FROM j WHERE was = 1 AND now = 0
       UNION ALL SELECT asset, old_owner, new_owner, 'owner_unresolved' FROM j
                 WHERE NOT na AND now = 0 AND new_owner IS NULL
       UNION ALL SELECT asset, old_owner, new_owner, 'owner_change' FROM j
                 WHERE was = 0 AND now = 0 AND old_owner IS DISTINCT FROM new_owner
       UNION ALL SELECT asset, old_owner, new_owner, 'not_in_inventory' FROM j WHERE nb
       UNION ALL SELECT asset, old_owner, new_owner, 'not_in_state' FROM j WHERE na""",
)
def _(spark, sf_dir):
    return R.snapshot_diff(snap_a(spark, sf_dir), snap_b(spark, sf_dir))


@bound("evidence_priority", "SELECT asset, CAST(supply_zero AS BIGINT) AS supply_zero, chain_owner, account, source FROM evidence")
def _(spark, sf_dir):
    return evidence(spark, sf_dir)


@bound("reconcile_state", "SELECT * FROM recon")
def _(spark, sf_dir):
    return recon(spark, sf_dir)


@bound(
    "audited_skip",
    """SELECT g.* FROM gaps g ANTI JOIN (SELECT * FROM audits WHERE complete = 1) a ON a.asset = g.asset
       AND a.account = g.account AND a.chain_owner = g.chain_owner AND a.state_owner = g.state_owner""",
)
def _(spark, sf_dir):
    found = gaps(spark, sf_dir)
    return R.pending_gaps(found, audits(found))


@bound(
    "reconcile_excused",
    """WITH x AS (SELECT g.chain_owner, a.asset IS NOT NULL AS excused FROM gaps g
                  LEFT JOIN (SELECT * FROM audits WHERE complete = 1 AND later = 0) a ON a.asset = g.asset
                  AND a.account = g.account AND a.chain_owner = g.chain_owner AND a.state_owner = g.state_owner)
       SELECT chain_owner, excused, count(*) AS gaps FROM x GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    found = gaps(spark, sf_dir)
    excused = R.excuse_gaps(found, audits(found))
    return excused.groupBy("chain_owner", "excused").agg(F.count(F.lit(1)).alias("gaps"))


@bound(
    "secondary_audit",
    """WITH j AS (SELECT a.burned = 1 AS burned, b.burned = 1 AS flag, b.owner IS NULL AS miss,
                         coalesce(a.owner = b.owner, false) AS same
                  FROM snap_a a JOIN snap_b b ON a.asset = b.asset)
       SELECT count(*) FILTER (NOT burned AND same) AS owner_match,
              count(*) FILTER (NOT burned AND NOT miss AND NOT same) AS owner_diff,
              count(*) FILTER (NOT burned AND miss) AS owner_missing, count(*) FILTER (burned AND flag) AS burn_match,
              count(*) FILTER (burned AND NOT flag) AS burn_regression,
              count(*) FILTER (NOT burned AND flag) AS burn_only_there,
              count(*) FILTER (NOT burned AND (flag OR miss OR NOT same)) AS gap_targets FROM j""",
)
def _(spark, sf_dir):
    return R.secondary_audit(snap_a(spark, sf_dir), snap_b(spark, sf_dir))


V.VIEWS["shifted"] = """
    SELECT tx, asset, CASE WHEN tx % 13 = 0 THEN buyer + 1 ELSE buyer END AS buyer, seller, market,
           CAST(price AS DOUBLE) / 100.0 + CASE tx % 11 WHEN 1 THEN 0.0000005 WHEN 2 THEN 0.01 WHEN 3 THEN 0.0000000001
               ELSE 0.0 END AS price
    FROM base WHERE tx % 17 <> 0"""


def expected(spark, sf_dir):
    return V.base(spark, sf_dir).select(
        "tx", "asset", "buyer", "seller", "market", (F.col("price").cast("double") / 100.0).alias("price")
    )


def shifted(spark, sf_dir):
    tx = F.col("tx")
    shift = F.when(tx % 11 == 1, 0.0000005).when(tx % 11 == 2, 0.01).when(tx % 11 == 3, 0.0000000001).otherwise(0.0)
    return (
        expected(spark, sf_dir)
        .filter(tx % 17 != 0)
        .withColumn("buyer", F.when(tx % 13 == 0, F.col("buyer") + 1).otherwise(F.col("buyer")))
        .withColumn("price", F.col("price") + shift)
    )


@bound(
    "backtest_compare",
    """SELECT b.tx, b.asset,
              CASE WHEN s.tx IS NULL THEN 'not_decoded'
                   WHEN s.buyer = b.buyer AND abs(s.price - CAST(b.price AS DOUBLE) / 100.0) <= 1e-9 THEN 'pass'
                   WHEN s.buyer = b.buyer AND b.market = 'RF'
                        AND abs(s.price - CAST(b.price AS DOUBLE) / 100.0) <= 1e-6 THEN 'legacy_pass'
                   ELSE 'fail' END AS verdict,
              CASE WHEN s.tx IS NULL THEN '' ELSE concat_ws('|', CASE WHEN s.buyer <> b.buyer THEN 'buyer' END,
                   CASE WHEN abs(s.price - CAST(b.price AS DOUBLE) / 100.0) > 1e-9 THEN 'price' END) END AS mismatched
       FROM base b LEFT JOIN shifted s ON s.tx = b.tx AND s.asset = b.asset""",
)
def _(spark, sf_dir):
    return R.backtest_compare(
        expected(spark, sf_dir),
        shifted(spark, sf_dir),
        ["tx", "asset"],
        ["buyer", "seller", "market"],
        ["price"],
        "price",
        legacy=F.col("market") == "RF",
    )


@bound(
    "watch_set",
    """WITH t AS (SELECT DISTINCT CAST(asset AS VARCHAR) AS key, 'asset' AS component FROM snap_b
                  UNION SELECT account, 'account' FROM snap_a UNION SELECT account, 'account' FROM snap_b
                  UNION SELECT 'special', 'special')
       SELECT component, count(*) AS keys FROM t GROUP BY 1
       UNION ALL SELECT 'all', count(DISTINCT key) FROM t""",
)
def _(spark, sf_dir):
    a, b = snap_a(spark, sf_dir), snap_b(spark, sf_dir)
    special = spark.range(1).select(F.lit("special").alias("key"))
    accounts = a.select("account").unionByName(b.select("account"))
    return U.watch_counts(U.watch_set({"asset": b.select("asset"), "account": accounts, "special": special}))


@bound(
    "set_diff",
    """SELECT account, 'missing' AS side FROM (SELECT account FROM snap_b EXCEPT SELECT account FROM snap_a)
       UNION ALL SELECT account, 'unexpected' FROM (SELECT account FROM snap_a EXCEPT SELECT account FROM snap_b)""",
)
def _(spark, sf_dir):
    return U.set_diff(snap_b(spark, sf_dir), snap_a(spark, sf_dir), "account")


@bound("set_intersect", "SELECT account FROM snap_a INTERSECT SELECT account FROM snap_b")
def _(spark, sf_dir):
    return U.set_intersect(snap_a(spark, sf_dir), snap_b(spark, sf_dir), "account")


V.VIEWS["found"] = """
    SELECT DISTINCT tx, asset AS key, 'program' AS source FROM sale_lines WHERE tx % 3 <> 0
    UNION SELECT tx, asset, 'asset' FROM sale_lines WHERE asset % 40 <> 0
    UNION SELECT tx, asset, 'owner' FROM sale_lines"""


def found(spark, sf_dir):
    lines = V.sale_lines(spark, sf_dir).select("tx", F.col("asset").alias("key"))
    return U.discovered_union(
        {"program": lines.filter(F.col("tx") % 3 != 0), "asset": lines.filter(F.col("key") % 40 != 0), "owner": lines}
    )


@bound("discovered_union", "SELECT tx, key, source FROM found")
def _(spark, sf_dir):
    return found(spark, sf_dir)


@bound(
    "probe_coverage",
    """WITH s AS (SELECT unnest(['program', 'asset', 'owner']) AS source),
            p AS (SELECT s.source, l.asset AS key, l.tx FROM last_sale l CROSS JOIN s)
       SELECT p.source, count(*) AS probes, count(*) FILTER (f.tx IS NULL) AS missed,
              count(*) FILTER (f.tx IS NULL) = 0 AS usable
       FROM p LEFT JOIN found f ON f.source = p.source AND f.key = p.key AND f.tx = p.tx GROUP BY 1""",
)
def _(spark, sf_dir):
    last = keep_last(V.sales(spark, sf_dir).select("asset", "ts", "tx"), ["asset"], ["ts", "tx"])
    probes = last.select(
        F.explode(F.array(F.lit("program"), F.lit("asset"), F.lit("owner"))).alias("source"),
        F.col("asset").alias("key"),
        "tx",
    )
    return U.probe_coverage(probes, found(spark, sf_dir))


@bound(
    "scan_complete",
    """SELECT count(*) AS seeded, count(*) FILTER (b.asset IS NOT NULL) AS done,
              count(*) = count(*) FILTER (b.asset IS NOT NULL) AS complete
       FROM part LEFT JOIN snap_b b ON b.asset = p_partkey""",
)
def _(spark, sf_dir):
    seeded = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"))
    done = snap_b(spark, sf_dir).select("asset", F.lit(1).alias("done"))
    return U.scan_complete(seeded.join(done, "asset", "left"), "done")


@bound(
    "gap_keys",
    """WITH i AS (SELECT b.account AS key, min(s.tx) AS since_seq FROM snap_b b ANTI JOIN snap_a a ON a.account = b.account
                  JOIN sales s ON 'A' || s.asset || '-' || s.buyer = b.account GROUP BY 1)
       SELECT DISTINCT l.tx, i.key FROM i JOIN sale_lines l ON 'A' || l.asset || '-' || l.buyer = i.key
       WHERE l.tx > i.since_seq AND l.tx % 4 <> 0""",
)
def _(spark, sf_dir):
    account = F.concat_ws("-", F.concat(F.lit("A"), F.col("asset").cast("string")), F.col("buyer").cast("string"))
    fresh = U.set_diff(snap_b(spark, sf_dir), snap_a(spark, sf_dir), "account").filter(F.col("side") == "missing")
    activity = V.sale_lines(spark, sf_dir).select(account.alias("key"), "tx", F.col("tx").alias("seq"))
    sold = V.sales(spark, sf_dir).select(account.alias("key"), "tx")
    introduced = (
        sold.join(fresh.select(F.col("account").alias("key")), "key", "left_semi")
        .groupBy("key")
        .agg(F.min("tx").alias("since_seq"))
    )
    pending = activity.filter(F.col("tx") % 4 == 0).select("tx")
    return U.gap_keys(introduced, activity, pending)


@bound(
    "version_changes",
    """SELECT coalesce(s.asset, b.asset) AS asset,
              CASE WHEN b.asset IS NULL THEN 'added' WHEN s.asset IS NULL THEN 'removed' ELSE 'changed' END AS status
       FROM (SELECT * FROM state WHERE asset % 50 <> 0) s FULL JOIN (SELECT * FROM state_base WHERE asset % 70 <> 0) b ON s.asset = b.asset
       WHERE b.asset IS NULL OR s.asset IS NULL OR s.latest_tx IS DISTINCT FROM b.latest_tx OR s.owner IS DISTINCT FROM b.owner
          OR s.burned <> b.burned OR s.locked <> b.locked OR s.activity_ts IS DISTINCT FROM b.activity_ts""",
)
def _(spark, sf_dir):
    """The state before and after the live sales, stored with digest trees; each lacks some assets of the other."""
    home = f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
    key = F.col("asset")
    before = V.state(spark, sf_dir, F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz")).filter(key % 70 != 0)
    write_digested(before, f"{home}/a", ["asset"], 64)
    write_digested(V.state(spark, sf_dir).filter(key % 50 != 0), f"{home}/b", ["asset"], 64)
    return version_changes(spark, f"{home}/a", f"{home}/b", ["asset"])
