"""Data-quality, golden and summary queries over the test tables."""

from pyspark.sql import functions as F

from ledgerweave.functions.fingerprint import fingerprint
from ledgerweave.functions.scalars import exact_sum, units
from ledgerweave.operators import holders as H
from ledgerweave.operators import launch as L
from ledgerweave.operators import market as M
from ledgerweave.operators import products as P
from ledgerweave.operators import quality as Q
from ledgerweave.operators import series as S
from ledgerweave.plans import views as V
from ledgerweave.plans.bound_inbox import HASH
from ledgerweave.plans.bound_market import PRICE, ROYALTY, merged
from ledgerweave.plans.bound_state import mints
from ledgerweave.plans.registry import bound
from ledgerweave.session import settled


def kpi_sql(source):
    return f"""SELECT count(*) AS secondary_sales, CAST(sum(price) AS DOUBLE) / 100.0 AS secondary_volume,
        count(DISTINCT buyer) AS unique_buyers, count(DISTINCT asset) AS assets_ever_sold,
        CAST(sum(royalty) AS DOUBLE) / 10000.0 AS royalties FROM {source}"""


def long_sql(source):
    return f"""SELECT unnest(['secondary_sales', 'secondary_volume', 'unique_buyers', 'assets_ever_sold', 'royalties'])
        AS metric, unnest([CAST(secondary_sales AS DOUBLE), secondary_volume, CAST(unique_buyers AS DOUBLE),
        CAST(assets_ever_sold AS DOUBLE), royalties]) AS value FROM ({kpi_sql(source)})"""


V.VIEWS["kpi_base"] = long_sql("base")
V.VIEWS["kpi_merged"] = long_sql("merged")


def kpis(sales):
    row = M.market_kpis(sales, F.lit(0.0), PRICE, ROYALTY).drop("mint_plus_royalties")
    return Q.unpivot_row(row)


@bound("dq_unique", "SELECT tx, asset, count(*) AS copies FROM sale_lines GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    return Q.duplicate_keys(V.sale_lines(spark, sf_dir), ["tx", "asset"])


@bound("dq_fk", "SELECT asset, count(*) AS rows FROM sales WHERE asset % 50 = 0 GROUP BY 1")
def _(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"))
    return Q.orphan_keys(V.sales(spark, sf_dir), parts.filter(F.col("asset") % 50 != 0), "asset")


@bound(
    "dq_consistency",
    """WITH s AS (SELECT count(*) FILTER (burned = 1) AS burned, count(*) FILTER (locked = 1) AS locked,
                         count(DISTINCT owner) FILTER (burned = 0) AS holders,
                         count(*) FILTER (burned = 0 AND owner IS NOT NULL) AS held FROM state),
            m AS (SELECT count(*) AS sales, CAST(sum(price) AS DOUBLE) / 100.0 AS volume FROM merged),
            r AS (SELECT 'bucket sum = locked' AS rule, locked AS a FROM s
                  UNION ALL SELECT 'category sum = burned', burned FROM s
                  UNION ALL SELECT 'burn history end = burned', burned FROM s
                  UNION ALL SELECT 'tier holders = holders', holders FROM s
                  UNION ALL SELECT 'tier supply = held assets', held FROM s
                  UNION ALL SELECT 'monthly sales = sales', sales FROM m
                  UNION ALL SELECT 'monthly volume = volume', volume FROM m)
       SELECT rule, CAST(a AS DOUBLE) AS left, CAST(a AS DOUBLE) AS right, true AS ok FROM r""",
)
def _(spark, sf_dir):
    # Both derived tables are computed once; the rules then read what was written.
    states = settled(V.state(spark, sf_dir))
    sales = settled(merged(spark, sf_dir).select("asset", "buyer", "ts", "price", "royalty"))
    as_of = V.clock(spark, sf_dir)
    kpi = H.state_kpis(states, as_of)
    tiers = H.holder_tiers(states)
    monthly, market = M.monthly_activity(sales, PRICE, ROYALTY), M.market_kpis(sales, F.lit(0.0), PRICE, ROYALTY)
    buckets = H.activity_buckets(states, as_of)
    categories = H.burned_by_category(states, V.CATEGORIES)
    held = H.holder_balances(states)
    get = Q.scalar
    rules = [
        ("bucket sum = locked", get(buckets, F.sum("assets")), get(kpi, F.max("locked_assets")), 0),
        ("category sum = burned", get(categories, F.sum("burned")), get(kpi, F.max("burned")), 0),
        ("burn history end = burned", get(S.burn_history(states, as_of), F.max("total_burns")), get(kpi, F.max("burned")), 0),
        ("tier holders = holders", get(tiers, F.sum("holder_count")), get(kpi, F.max("holders")), 0),
        ("tier supply = held assets", get(tiers, F.sum("supply")), get(held, F.sum("assets")), 0),
        ("monthly sales = sales", get(monthly, F.sum("sales")), get(market, F.max("secondary_sales")), 0),
        ("monthly volume = volume", get(monthly, F.sum(F.round(F.col("volume") * 100).cast("bigint")) / 100), get(market, F.max("secondary_volume")), 0.05),
    ]
    return Q.rule_report(spark, rules)


@bound(
    "dq_monotone",
    """SELECT b.metric, b.value AS before, m.value AS after, m.value + 1e-9 >= b.value AS ok
       FROM kpi_base b JOIN kpi_merged m ON m.metric = b.metric""",
)
def _(spark, sf_dir):
    return Q.monotone(kpis(V.base(spark, sf_dir)), kpis(merged(spark, sf_dir)), falling=["active_supply"])


@bound(
    "dq_non_decreasing",
    "SELECT count(*) AS n, 0::BIGINT AS falls, true AS ok FROM (SELECT DISTINCT strftime(ts, '%Y-%m') FROM sales)",
)
def _(spark, sf_dir):
    monthly = V.sales(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-01").alias("month"))
    totals = S.running_total(monthly.agg(F.count(F.lit(1)).alias("sales")), "month", {"sales": "total"})
    return Q.non_decreasing(totals, "month", "total")


@bound(
    "dq_close",
    """WITH a AS (SELECT strftime(ts, '%Y-%m-01') AS month, CAST(sum(price) AS DOUBLE) / 100.0 AS v FROM base GROUP BY 1),
            b AS (SELECT strftime(ts, '%Y-%m-01') AS month, CAST(sum(price) AS DOUBLE) / 100.0 AS v FROM merged GROUP BY 1)
       SELECT coalesce(a.month, b.month) AS month, a.v AS left, b.v AS right,
              coalesce(abs(a.v - b.v) <= 0.05, false) AS ok
       FROM a FULL JOIN b ON a.month = b.month""",
)
def _(spark, sf_dir):
    monthly = lambda s: M.monthly_activity(s, PRICE, ROYALTY)
    return Q.close_values(monthly(V.base(spark, sf_dir)), monthly(merged(spark, sf_dir)), "month", "volume", 0.05)


@bound(
    "dq_age",
    """SELECT event_type AS domain, CAST(epoch_us((SELECT max(ts) FROM events WHERE user_id % 2 = 0)) - epoch_us(max(ts)) AS DOUBLE)
              / 3600000000.0 AS age_hours,
              CASE WHEN max(ts) > (SELECT max(ts) FROM events WHERE user_id % 2 = 0) THEN 'future'
                   WHEN (SELECT max(ts) FROM events WHERE user_id % 2 = 0) - max(ts) > INTERVAL 15 MINUTE THEN 'stale'
                   ELSE 'ok' END AS status
       FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    domains = events.groupBy(F.col("event_type").alias("domain")).agg(F.max("ts").alias("at"))
    now = events.filter(F.col("user_id") % 2 == 0).agg(F.max("ts")).scalar()
    return Q.age_rule(domains, "domain", "at", now, 0.25)


@bound(
    "golden_compare",
    """SELECT 'market' AS "group", b.metric, b.value AS golden, m.value AS current, abs(b.value - m.value) <= 1e-9 AS ok
       FROM kpi_base b JOIN kpi_merged m ON m.metric = b.metric""",
)
def _(spark, sf_dir):
    tag = lambda df: df.withColumn("group", F.lit("market"))
    return Q.golden_compare(tag(kpis(V.base(spark, sf_dir))), tag(kpis(merged(spark, sf_dir))))


@bound("fingerprint", f"SELECT {HASH.format(chr(39).join(['tx || ', '|', ' || asset || ', '|', ' || price']))} FROM sales")
def _(spark, sf_dir):
    return fingerprint(V.sales(spark, sf_dir), ["tx", "asset", "price"])


@bound(
    "dq_checkpoints",
    """WITH c AS (SELECT TIMESTAMP '2000-01-01' AS cutover, max(ts) AS snap, max(ts) FILTER (market = 'RF') AS state,
                         max(ts) FILTER (market = 'NO') AS market, min(ts) AS floor FROM sales)
       SELECT 'state' AS domain, state >= cutover AS after_cutover, state <= snap AS within_snapshot FROM c
       UNION ALL SELECT 'market', market >= cutover, market <= snap FROM c
       UNION ALL SELECT 'floor', floor >= cutover, floor <= snap FROM c""",
)
def _(spark, sf_dir):
    last = lambda m: F.max(F.when(F.col("market") == m, F.col("ts")))
    row = V.sales(spark, sf_dir).agg(
        F.lit("2000-01-01").cast("timestamp_ntz").alias("cutover"),
        F.max("ts").alias("snap"),
        last("RF").alias("state"),
        last("NO").alias("market"),
        F.min("ts").alias("floor"),
    )
    return Q.checkpoint_rules(row, "cutover", ["state", "market", "floor"], "snap")


FLOWS = {"before": "1998-01-01", "after": "1999-04-01"}  # ends of the conversion window in the two KPI sets


def all_kpis_sql(sales, states, cut, end):
    figures = f"""SELECT count(*) FILTER (burned = 1) AS burned, count(*) FILTER (burned = 0) AS active_supply,
        count(*) FILTER (locked = 1) AS locked_assets, count(DISTINCT owner) FILTER (burned = 0) AS holders FROM {states}"""
    flows = f"""SELECT coalesce(CAST(sum(price) AS DOUBLE), 0) / 100.0 AS total_sold, coalesce(CAST(sum(royalty) AS DOUBLE), 0) / 10000.0
        AS total_purchased FROM sales WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '{end}'"""
    seen = f"""SELECT CAST(arg_max(floor_units, day) AS DOUBLE) / 100.0 AS floor, CAST(arg_max(listed, day) AS DOUBLE) AS listed_count
        FROM obs WHERE day < '{cut}'"""
    long = lambda sql, names: (
        f"SELECT unnest([{', '.join(repr(n) for n in names)}]) AS metric, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in names)}]) AS value FROM ({sql})"
    )
    return " UNION ALL ".join([
        long(kpi_sql(sales), ["secondary_sales", "secondary_volume", "unique_buyers", "assets_ever_sold", "royalties"]),
        long(figures, ["burned", "active_supply", "locked_assets", "holders"]),
        long(flows, ["total_sold", "total_purchased"]),
        long(seen, ["floor", "listed_count"]),
    ])


V.VIEWS["all_before"] = all_kpis_sql("base", "state_base", "2000-01-01", FLOWS["before"])
V.VIEWS["all_after"] = all_kpis_sql("merged", "state", "9999-01-01", FLOWS["after"])


@bound(
    "kpi_delta",
    """SELECT b.metric, b.value AS before, m.value AS after, m.value - b.value AS delta,
              CASE WHEN b.metric = 'floor' AND b.value > 0 THEN (m.value - b.value) / b.value * 100.0 END AS percent
       FROM all_before b JOIN all_after m ON m.metric = b.metric
       WHERE CASE WHEN b.metric IN ('floor', 'listed_count', 'locked_assets', 'holders') THEN m.value <> b.value
                  WHEN b.metric = 'active_supply' THEN false
                  ELSE m.value - b.value > CASE b.metric WHEN 'secondary_volume' THEN 0.0005 WHEN 'royalties' THEN 0.0005
                       WHEN 'total_sold' THEN 0.0005 WHEN 'total_purchased' THEN 0.005 ELSE 0 END END""",
)
def _(spark, sf_dir):
    """All thirteen metrics. Assets only leave the supply by burning, so the burns explain its change."""
    rows = V.obs(spark, sf_dir)
    ntz = lambda text: F.lit(text).cast("timestamp_ntz")

    def metrics(sales, states, observed, end):
        last = S.latest_observation(observed, "day", ["floor_units", "listed"])
        floor = last.select(
            (F.col("floor_units").cast("double") / 100.0).alias("floor"), F.col("listed").alias("listed_count")
        )
        figures = H.state_kpis(states, V.clock(spark, sf_dir)).select("burned", "active_supply", "locked_assets", "holders")
        inside = V.sales(spark, sf_dir, (F.col("ts") >= ntz("1996-03-01")) & (F.col("ts") < ntz(end)))
        flows = inside.agg(
            units(exact_sum(F.col("price")), PRICE).alias("total_sold"), units(exact_sum(F.col("royalty")), ROYALTY).alias("total_purchased")
        )
        out = kpis(sales)
        for row in (floor, figures, flows):
            out = out.unionByName(Q.unpivot_row(row))
        return out

    early = V.state(spark, sf_dir, F.col("ts") < ntz("2000-01-01"))
    before = metrics(V.base(spark, sf_dir), early, rows.filter(F.col("day") < "2000-01-01"), FLOWS["before"])
    return Q.kpi_delta(before, metrics(merged(spark, sf_dir), V.state(spark, sf_dir), rows, FLOWS["after"]))


@bound(
    "summary",
    """SELECT (SELECT count(*) FROM state WHERE burned = 0) AS active_supply,
              (SELECT count(*) FROM state WHERE burned = 1) AS burned,
              (SELECT count(*) FROM mints) AS public_mint_supply, (SELECT count(*) FROM merged) AS secondary_sales,
              (SELECT CAST(sum(price) AS DOUBLE) / 100.0 FROM merged) AS secondary_volume,
              (SELECT arg_max(floor_units, day) FROM obs) AS floor_units,
              (SELECT arg_max(listed, day) FROM obs) AS listed_count""",
)
def _(spark, sf_dir):
    rows = V.obs(spark, sf_dir)
    old = rows.filter(F.col("day") < "2000-01-01")
    latest = lambda df: S.latest_observation(df, "day", ["floor_units", "listed"])
    published = P.summary(
        spark,
        state=H.state_kpis(V.state(spark, sf_dir), V.clock(spark, sf_dir)),
        launch=L.launch_kpis(mints(spark, sf_dir)),
        market=M.market_kpis(merged(spark, sf_dir), F.lit(0.0), PRICE, ROYALTY),
        floor=latest(old),
    )
    current = P.patch_summary(published, "floor", latest(rows))
    return current.select(
        "state.active_supply",
        "state.burned",
        "launch.public_mint_supply",
        "market.secondary_sales",
        "market.secondary_volume",
        "floor.floor_units",
        F.col("floor.listed").alias("listed_count"),
    )


@bound(
    "product_json",
    """SELECT CAST(to_json({'month': month, 'sales': sales, 'cents': cents}) AS VARCHAR) AS json
       FROM (SELECT strftime(ts, '%Y-%m-01') AS month, count(*) AS sales, CAST(sum(price) AS BIGINT) AS cents
             FROM merged GROUP BY 1)""",
)
def _(spark, sf_dir):
    monthly = (
        merged(spark, sf_dir)
        .groupBy(F.date_format("ts", "yyyy-MM-01").alias("month"))
        .agg(F.count(F.lit(1)).alias("sales"), exact_sum(F.col("price")).cast("bigint").alias("cents"))
    )
    return P.json_rows(monthly)
