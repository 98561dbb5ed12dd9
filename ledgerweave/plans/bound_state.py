"""Asset-state and launch queries over the test tables."""

from pyspark.sql import functions as F

from ledgerweave.functions.ordered import keep_last
from ledgerweave.operators import holders as H
from ledgerweave.operators import launch as L
from ledgerweave.operators import series as S
from ledgerweave.plans import views as V
from ledgerweave.plans.registry import bound

AGE = "(epoch_us((SELECT as_of FROM clock)) - epoch_us(activity_ts)) / 86400000000.0"
BUCKET = f"""CASE WHEN activity_ts IS NULL THEN 'Never quested' WHEN {AGE} <= 7 THEN 'Active 0–7d'
    WHEN {AGE} <= 30 THEN 'Idle 8–30d' WHEN {AGE} <= 90 THEN 'Idle 31–90d' WHEN {AGE} <= 180 THEN 'Idle 91–180d'
    WHEN {AGE} <= 365 THEN 'Idle 181–365d' ELSE 'Idle 1+ year' END"""

V.VIEWS["mints"] = """
    SELECT o_orderkey AS asset, o_custkey AS payer, o_orderdate AS ts,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Phase I' WHEN '2-HIGH' THEN 'Phase II'
                ELSE 'Phase III' END AS phase
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"""
V.VIEWS["balances"] = """
    SELECT owner, count(*) AS assets FROM state WHERE burned = 0 AND owner IS NOT NULL GROUP BY 1"""


def mints(spark, sf_dir):
    phase = F.col("o_orderpriority")
    return (
        V.table(spark, sf_dir, "orders")
        .filter(phase.isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
        .select(
            F.col("o_orderkey").alias("asset"),
            F.col("o_custkey").alias("payer"),
            F.col("o_orderdate").alias("ts"),
            F.when(phase == "1-URGENT", "Phase I").when(phase == "2-HIGH", "Phase II").otherwise("Phase III").alias("phase"),
        )
    )


@bound(
    "state_kpis",
    f"""SELECT count(*) FILTER (burned = 0) AS active_supply,
               count(DISTINCT owner) FILTER (burned = 0) AS holders,
               count(*) FILTER (locked = 1) AS locked_assets,
               count(*) FILTER (locked = 1 AND {AGE} <= 30) AS active_30d,
               count(*) FILTER (locked = 1 AND (activity_ts IS NULL OR {AGE} > 365)) AS dormant_1y,
               count(*) FILTER (burned = 1) AS burned,
               round_even(100.0::DOUBLE * count(*) FILTER (locked = 1) / count(*) FILTER (burned = 0), 1) AS locked_pct
        FROM state""",
)
def _(spark, sf_dir):
    return H.state_kpis(V.state(spark, sf_dir), V.clock(spark, sf_dir), dense=True)


@bound("holder_balances", "SELECT owner, assets FROM balances")
def _(spark, sf_dir):
    return H.holder_balances(V.state(spark, sf_dir))


@bound(
    "holder_tiers",
    """WITH t AS (SELECT * FROM (VALUES (1, '1-4', 1, 4), (2, '5-14', 5, 14), (3, '15-29', 15, 29),
                    (4, '30-49', 30, 49), (5, '50-99', 50, 99), (6, '100+', 100, 9223372036854775807)) v(ord, tier, lo, hi))
       SELECT CAST(ord AS BIGINT) AS ord, tier, count(assets) AS holder_count,
              CAST(coalesce(sum(assets), 0) AS BIGINT) AS supply,
              round_even(100.0::DOUBLE * coalesce(sum(assets), 0) / (SELECT count(*) FROM state WHERE burned = 0), 1)
                  AS supply_pct
       FROM t LEFT JOIN balances ON assets BETWEEN lo AND hi GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return H.holder_tiers(V.state(spark, sf_dir))


@bound(
    "activity_buckets",
    f"""WITH b AS (SELECT {BUCKET} AS bucket FROM state WHERE locked = 1)
        SELECT CAST(ord AS BIGINT) AS ord, d.bucket, count(b.bucket) AS assets
        FROM (VALUES (1, 'Active 0–7d'), (2, 'Idle 8–30d'), (3, 'Idle 31–90d'), (4, 'Idle 91–180d'),
                     (5, 'Idle 181–365d'), (6, 'Idle 1+ year'), (7, 'Never quested')) d(ord, bucket)
        LEFT JOIN b ON b.bucket = d.bucket GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return H.activity_buckets(V.state(spark, sf_dir), V.clock(spark, sf_dir))


@bound(
    "burned_by_rarity",
    """SELECT CAST(ord AS BIGINT) AS ord, d.category, count(s.asset) AS burned
       FROM (VALUES (1, 'ECONOMY'), (2, 'STANDARD'), (3, 'SMALL'), (4, 'MEDIUM'), (5, 'LARGE'), (6, 'PROMO'))
            d(ord, category)
       LEFT JOIN state s ON s.category = d.category AND s.burned = 1 GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return H.burned_by_category(V.state(spark, sf_dir), V.CATEGORIES)


@bound(
    "burn_history",
    """WITH m AS (SELECT CAST(date_trunc('month', burn_ts) AS DATE) AS d, count(*) AS n FROM state
                  WHERE burned = 1 GROUP BY 1),
            s AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM m),
                         (SELECT CAST(date_trunc('month', as_of) AS DATE) FROM clock), INTERVAL 1 MONTH)) AS DATE) AS d)
       SELECT strftime(s.d, '%Y-%m-%d') AS month, coalesce(n, 0) AS monthly_burns,
              CAST(sum(coalesce(n, 0)) OVER (ORDER BY s.d) AS BIGINT) AS total_burns
       FROM s LEFT JOIN m ON s.d = m.d""",
)
def _(spark, sf_dir):
    return S.burn_history(V.state(spark, sf_dir), V.clock(spark, sf_dir))


@bound(
    "share_of_total",
    """WITH c AS (SELECT category, count(*) AS burned FROM state WHERE burned = 1 GROUP BY 1)
       SELECT category, burned, 100.0::DOUBLE * burned / CAST(sum(burned) OVER () AS DOUBLE) AS share_pct FROM c""",
)
def _(spark, sf_dir):
    counts = V.state(spark, sf_dir).filter(F.col("burned") == 1).groupBy("category").agg(F.count(F.lit(1)).alias("burned"))
    return H.share_of_total(counts, "burned", "share_pct")


@bound(
    "top_holders",
    """SELECT rank() OVER (ORDER BY assets DESC) AS rank, owner, assets
       FROM (SELECT * FROM balances ORDER BY assets DESC, owner LIMIT 10)""",
)
def _(spark, sf_dir):
    return H.top_holders(H.holder_balances(V.state(spark, sf_dir)))


@bound("rarity_lookup", "SELECT s.asset, s.buyer AS owner, p_type AS category FROM last_sale s JOIN part ON p_partkey = s.asset")
def _(spark, sf_dir):
    last = keep_last(V.sales(spark, sf_dir).select("asset", "ts", "tx", "buyer"), ["asset"], ["ts", "tx"])
    parts = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), F.col("p_type").alias("category"))
    return H.category_lookup(last.select("asset", F.col("buyer").alias("owner")), parts)


@bound(
    "asset_listing",
    f"""SELECT number, category, CASE category WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
               WHEN 'SMALL' THEN 4 WHEN 'STANDARD' THEN 5 ELSE 6 END::BIGINT AS category_rank, locked,
               {BUCKET} AS bucket, coalesce(strftime(activity_ts, '%Y-%m-%d'), '') AS last_activity
        FROM state WHERE locked = 1""",
)
def _(spark, sf_dir):
    return H.asset_listing(
        V.state(spark, sf_dir), V.clock(spark, sf_dir), V.CATEGORIES, locked=True, sort="category"
    )


@bound(
    "recon_summary",
    """SELECT CAST(sum(burned) AS BIGINT) AS burned, CAST(count(*) - sum(burned) AS BIGINT) AS active,
              CAST(sum(locked) FILTER (burned = 0) AS BIGINT) AS locked,
              count(DISTINCT owner) FILTER (burned = 0) AS holders FROM state""",
)
def _(spark, sf_dir):
    return H.recon_summary(V.state(spark, sf_dir))


@bound(
    "key_frontier",
    """SELECT count(*) AS active_assets, count(DISTINCT owner) AS owners,
              count(*) FILTER (owner IS NULL) AS ownerless FROM state WHERE burned = 0""",
)
def _(spark, sf_dir):
    return H.key_frontier(V.state(spark, sf_dir))


@bound(
    "launch_kpis",
    """SELECT count(*) AS public_mint_supply, count(DISTINCT payer) AS unique_minters, 1.5::DOUBLE AS mint_price,
              count(*) * 1.5::DOUBLE AS mint_proceeds FROM mints""",
)
def _(spark, sf_dir):
    return L.launch_kpis(mints(spark, sf_dir), dense=True)


@bound(
    "launch_phases",
    """SELECT CASE phase WHEN 'Phase I' THEN 1 WHEN 'Phase II' THEN 2 ELSE 3 END::BIGINT AS ord, phase,
              count(*) AS minted, count(DISTINCT payer) AS unique_minters,
              strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_mint, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_mint
       FROM mints GROUP BY phase""",
)
def _(spark, sf_dir):
    return L.launch_phases(mints(spark, sf_dir))


@bound(
    "mint_distribution",
    """SELECT n AS assets_minted, count(*) AS minters, n * count(*) AS total_assets
       FROM (SELECT payer, count(*) AS n FROM mints GROUP BY 1) GROUP BY n""",
)
def _(spark, sf_dir):
    return L.mint_distribution(mints(spark, sf_dir))
