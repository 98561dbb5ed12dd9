"""Sale-ledger and time-series queries over the test tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerweave.functions.ordered import keep_first
from ledgerweave.functions.scalars import exact_sum
from ledgerweave.operators import market as M
from ledgerweave.operators import series as S
from ledgerweave.plans import views as V
from ledgerweave.plans.registry import bound
from ledgerweave.session import settled

PRICE, ROYALTY = 2, 4


def merged(spark, sf_dir):
    return M.merge_ledgers(V.base(spark, sf_dir), V.live(spark, sf_dir))


V.VIEWS["merged"] = """
    SELECT * FROM base UNION ALL
    SELECT l.* FROM live l ANTI JOIN base b ON l.tx = b.tx AND l.asset = b.asset"""


@bound(
    "keep_first",
    "SELECT tx, asset, CAST(line AS BIGINT) AS line, seller, buyer, price, royalty, market FROM sales",
)
def _(spark, sf_dir):
    rows = keep_first(V.sale_lines(spark, sf_dir), ["tx", "asset"], ["line", "seller"])
    return rows.select(
        "tx", "asset", F.col("line").cast("bigint").alias("line"), "seller", "buyer", "price", "royalty", "market"
    )


@bound("ledger_merge", "SELECT tx, asset, buyer, seller, price, royalty FROM merged")
def _(spark, sf_dir):
    return merged(spark, sf_dir).select("tx", "asset", "buyer", "seller", "price", "royalty")


@bound(
    "ledger_append",
    "SELECT tx, asset, buyer, seller, price, royalty FROM merged",
)
def _(spark, sf_dir):
    """Every third fresh row comes twice, the second time with a higher price; one of each key is kept."""
    live = V.live(spark, sf_dir)
    twice = live.filter(F.col("tx") % 3 == 0).withColumn("price", F.col("price") + 7)
    ledger = M.append_new(V.base(spark, sf_dir), live.unionByName(twice))
    return ledger.select("tx", "asset", "buyer", "seller", "price", "royalty")


@bound(
    "interval_slice",
    """SELECT tx, asset, strftime(ts, '%Y-%m-%d') AS date FROM sale_lines
       WHERE ts > TIMESTAMP '1998-06-30' AND ts <= TIMESTAMP '1998-12-31'""",
)
def _(spark, sf_dir):
    ntz = lambda text: F.lit(text).cast("timestamp_ntz")
    rows = S.interval_slice(V.sale_lines(spark, sf_dir), "ts", ntz("1998-06-30"), ntz("1998-12-31"))
    return rows.select("tx", "asset", F.date_format("ts", "yyyy-MM-dd").alias("date"))


SALE_ROW_SQL = """
    SELECT tx, asset, CASE WHEN asset % 5 = 0 THEN 'n/a' ELSE coalesce(CAST(p_partkey AS VARCHAR), '') END AS number,
           coalesce(p_type, '') AS name, substr(market, 1, 1) AS marketplace, 'by ' || substr(market, 2) AS price_method,
           '0' AS price_recovered, CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR) AS block_time,
           strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000 UTC' AS utc, strftime(ts, '%Y-%m-%d') AS sale_date,
           strftime(ts, '%Y-%m') AS sale_month, strftime(ts, '%Y') AS sale_year, market AS marketplace_detail,
           'direct_program_live' AS attribution_method, market AS direct_program_families, buyer, seller,
           rtrim(rtrim(CAST(CAST(price AS DECIMAL(38,9)) / 100 AS DECIMAL(38,9))::VARCHAR, '0'), '.') AS gross_price,
           'LIVE_DETECTED_SALE' AS sale_class, '0' AS legacy_sale,
           t(royalty) AS royalty_first, t(royalty // 9) AS royalty_second, t(royalty + royalty // 9) AS royalty_total,
           CASE WHEN royalty > 0 THEN '1' ELSE '0' END AS royalty_paid
    FROM sales LEFT JOIN part ON p_partkey = asset"""


def _trim_sql(expr: str) -> str:
    whole = f"CAST({expr} // 10000 AS VARCHAR)"
    part = f"rtrim(lpad(CAST({expr} % 10000 AS VARCHAR), 4, '0'), '0')"
    return f"({whole} || CASE WHEN {part} = '' THEN '' ELSE '.' || {part} END)"


_price = "(CAST(price // 100 AS VARCHAR) || CASE WHEN rtrim(lpad(CAST(price % 100 AS VARCHAR), 2, '0'), '0') = '' "
_price += "THEN '' ELSE '.' || rtrim(lpad(CAST(price % 100 AS VARCHAR), 2, '0'), '0') END)"
_sql = SALE_ROW_SQL.replace(
    "rtrim(rtrim(CAST(CAST(price AS DECIMAL(38,9)) / 100 AS DECIMAL(38,9))::VARCHAR, '0'), '.')", _price
)
for _expr in ["royalty + royalty // 9", "royalty // 9", "royalty"]:
    _sql = _sql.replace(f" t({_expr})", f" {_trim_sql('(' + _expr + ')')}")


@bound("sale_row", _sql)
def _(spark, sf_dir):
    """Every fifth asset has a number that is not one."""
    rows = V.sales(spark, sf_dir).withColumns(
        {
            "royalty_second": F.expr("royalty div 9"),
            "marketplace": F.substring("market", 1, 1),
            "method": F.concat(F.lit("by "), F.substring("market", 2, 9)),
        }
    )
    key = F.col("p_partkey")
    number = F.when(key % 5 == 0, "n/a").otherwise(F.concat(key.cast("string"), F.lit(".0")))
    assets = V.table(spark, sf_dir, "part").select(key.alias("asset"), number.alias("number"), F.col("p_type").alias("name"))
    return M.sale_rows(rows, assets, PRICE, ROYALTY)


@bound(
    "market_kpis",
    """SELECT count(*) AS secondary_sales, CAST(sum(price) AS DOUBLE) / 100.0 AS secondary_volume,
              count(DISTINCT buyer) AS unique_buyers, count(DISTINCT asset) AS assets_ever_sold,
              CAST(sum(royalty) AS DOUBLE) / 10000.0 AS royalties,
              14850.0::DOUBLE + CAST(sum(royalty) AS DOUBLE) / 10000.0 AS mint_plus_royalties
       FROM merged""",
)
def _(spark, sf_dir):
    sales = settled(merged(spark, sf_dir).select("buyer", "asset", "price", "royalty"))
    return M.market_kpis(sales, F.lit(14850.0), PRICE, ROYALTY, dense=True)


@bound(
    "monthly_activity",
    """SELECT strftime(ts, '%Y-%m-01') AS month, count(*) AS sales, CAST(sum(price) AS DOUBLE) / 100.0 AS volume,
              CAST(sum(royalty) AS DOUBLE) / 10000.0 AS royalties
       FROM merged GROUP BY 1""",
)
def _(spark, sf_dir):
    return M.monthly_activity(merged(spark, sf_dir), PRICE, ROYALTY)


@bound(
    "daily_activity",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS sales, CAST(sum(price) AS DOUBLE) / 100.0 AS volume
       FROM merged GROUP BY 1""",
)
def _(spark, sf_dir):
    return M.daily_activity(merged(spark, sf_dir), PRICE)


@bound(
    "first_resale",
    """WITH f AS (SELECT asset, min(ts) AS first_ts FROM base GROUP BY 1),
         l AS (SELECT DISTINCT asset FROM live),
         b AS (SELECT CASE WHEN first_ts IS NULL AND l.asset IS NOT NULL THEN '>1y'
                           WHEN first_ts IS NULL THEN 'Never sold'
                           WHEN d <= 1 THEN '≤24h' WHEN d <= 7 THEN '2–7d' WHEN d <= 30 THEN '8–30d'
                           WHEN d <= 90 THEN '31–90d' WHEN d <= 365 THEN '91–365d' ELSE '>1y' END AS bucket
               FROM (SELECT p_partkey, f.first_ts, date_diff('day', TIMESTAMP '1995-01-01', f.first_ts) AS d
                     FROM part LEFT JOIN f ON p_partkey = f.asset) x LEFT JOIN l ON x.p_partkey = l.asset)
       SELECT CAST(d.ord AS BIGINT) AS ord, d.bucket, count(b.bucket) AS assets
       FROM (VALUES (1, '≤24h'), (2, '2–7d'), (3, '8–30d'), (4, '31–90d'), (5, '91–365d'), (6, '>1y'),
                    (7, 'Never sold')) d(ord, bucket)
       LEFT JOIN b ON b.bucket = d.bucket GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    assets = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("asset"), F.lit(V.ORIGIN).cast("timestamp_ntz").alias("origin")
    )
    return M.first_resale(assets, V.base(spark, sf_dir), V.live(spark, sf_dir))


@bound(
    "conversion_history",
    """WITH m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS d, sum(price) AS p, sum(royalty) AS r
                  FROM sales GROUP BY 1),
         s AS (SELECT CAST(x AS DATE) AS d
               FROM (SELECT unnest(generate_series(DATE '1996-03-01', DATE '1999-03-01', INTERVAL 1 MONTH)) AS x)),
         j AS (SELECT s.d, coalesce(p, 0) AS p, coalesce(r, 0) AS r FROM s LEFT JOIN m ON s.d = m.d)
       SELECT strftime(d, '%Y-%m-%d') AS month, CAST(p AS DOUBLE) / 100.0 AS price,
              CAST(sum(p) OVER (ORDER BY d) AS DOUBLE) / 100.0 AS total_price,
              CAST(r AS DOUBLE) / 10000.0 AS royalty,
              CAST(sum(r) OVER (ORDER BY d) AS DOUBLE) / 10000.0 AS total_royalty
       FROM j""",
)
def _(spark, sf_dir):
    ntz = lambda text: F.lit(text).cast("timestamp_ntz")
    inside = (F.col("ts") >= ntz("1996-03-01")) & (F.col("ts") < ntz("1999-04-01"))
    return S.conversion_history(
        V.sales(spark, sf_dir, inside), "1996-03-01", "1999-03-01", {"price": PRICE, "royalty": ROYALTY}
    )


@bound(
    "running_total",
    """WITH m AS (SELECT strftime(ts, '%Y-%m-01') AS month, count(*) AS sales FROM sales GROUP BY 1)
       SELECT month, sales, CAST(sum(sales) OVER (ORDER BY month) AS BIGINT) AS total_sales FROM m""",
)
def _(spark, sf_dir):
    monthly = V.sales(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-01").alias("month"))
    return S.running_total(monthly.agg(F.count(F.lit(1)).alias("sales")), "month", {"sales": "total_sales"})


@bound(
    "resample_sum",
    """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS date, count(*) AS sales,
              CAST(sum(price) AS DOUBLE) / 100.0 AS volume
       FROM sales GROUP BY 1""",
)
def _(spark, sf_dir):
    daily = (
        V.sales(spark, sf_dir)
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("sales"), exact_sum(F.col("price")).alias("cents"))
    )
    weekly = S.resample_sum(daily, "day", "1w", ["sales", "cents"])
    return weekly.select(
        "date", F.col("sales").cast("bigint").alias("sales"), (F.col("cents").cast("double") / 100.0).alias("volume")
    )


@bound(
    "resample_last",
    """SELECT strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS date,
              arg_max(floor_units, day) AS floor_units, arg_max(listed, day) AS listed
       FROM obs GROUP BY 1""",
)
def _(spark, sf_dir):
    return S.resample_last(V.obs(spark, sf_dir), "day", "1w", ["floor_units", "listed"])


@bound(
    "range_filter",
    """SELECT day, floor_units, listed FROM obs
       WHERE CAST(day AS DATE) BETWEEN (SELECT greatest(max(CAST(day AS DATE)) - INTERVAL 12 MONTH,
                                                        min(CAST(day AS DATE))) FROM obs)
                                   AND (SELECT max(CAST(day AS DATE)) FROM obs)""",
)
def _(spark, sf_dir):
    return S.range_filter(V.obs(spark, sf_dir), "day", "1y")


@bound(
    "period_totals",
    """SELECT count(*) AS days, CAST(sum(listed) AS BIGINT) AS listed, CAST(sum(floor_units) AS BIGINT) AS floor_units
       FROM obs WHERE CAST(day AS DATE) BETWEEN (SELECT max(CAST(day AS DATE)) - INTERVAL 1 MONTH FROM obs)
                                            AND (SELECT max(CAST(day AS DATE)) FROM obs)""",
)
def _(spark, sf_dir):
    rows = S.range_filter(V.obs(spark, sf_dir), "day", "1m")
    return rows.agg(
        F.count(F.lit(1)).alias("days"),
        *[exact_sum(F.col(c)).cast("bigint").alias(c) for c in ("listed", "floor_units")],  # one row per day
    )


@bound(
    "latest_observation",
    "SELECT max(day) AS as_of, arg_max(floor_units, day) AS floor_units, arg_max(listed, day) AS listed FROM obs",
)
def _(spark, sf_dir):
    return S.latest_observation(V.obs(spark, sf_dir), "day", ["floor_units", "listed"])


RAW_OBS_SQL = """
    SELECT o_orderkey AS id,
           CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN 'n/a'
                ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS floor_raw,
           CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '-3' WHEN 2 THEN '4.5' WHEN 3 THEN 'false'
                ELSE CAST(o_custkey AS VARCHAR) END AS listed_raw
    FROM orders"""


@bound(
    "observation_rules",
    f"""WITH raw AS ({RAW_OBS_SQL}),
        r AS (SELECT *, CASE WHEN floor_raw IS NULL THEN 'floor missing' WHEN listed_raw IS NULL THEN 'count missing'
                WHEN try_cast(floor_raw AS DOUBLE) IS NULL THEN 'floor not numeric'
                WHEN try_cast(listed_raw AS DOUBLE) IS NULL THEN 'count not numeric'
                WHEN CAST(floor_raw AS DOUBLE) < 0 OR CAST(listed_raw AS DOUBLE) < 0 THEN 'negative'
                WHEN CAST(listed_raw AS DOUBLE) <> floor(CAST(listed_raw AS DOUBLE)) THEN 'count not whole' END AS reason
              FROM raw)
        SELECT id, reason, CASE WHEN reason IS NULL THEN CAST(floor_raw AS DOUBLE) / 100.0 END AS floor,
               CASE WHEN reason IS NULL THEN CAST(listed_raw AS BIGINT) END AS listed_count
        FROM r""",
)
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = V.table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 7 == 1, "true")
        .when(key % 7 == 2, "n/a")
        .when(key % 7 != 0, V.cents("o_totalprice").cast("string"))
        .alias("floor_raw"),
        F.when(key % 11 == 1, "-3")
        .when(key % 11 == 2, "4.5")
        .when(key % 11 == 3, "false")
        .when(key % 11 != 0, F.col("o_custkey").cast("string"))
        .alias("listed_raw"),
    )
    return S.observation_rules(raw, "floor_raw", "listed_raw", PRICE).select("id", "reason", "floor", "listed_count")


@bound(
    "daily_append_once",
    """WITH h AS (SELECT * FROM obs WHERE day <= '2000-12-31'),
            f AS (SELECT * REPLACE (listed + 1 AS listed) FROM obs WHERE day >= '2000-06-01')
       SELECT * FROM h UNION ALL SELECT * FROM f WHERE day > (SELECT max(day) FROM h) AND day NOT LIKE '%-15'""",
)
def _(spark, sf_dir):
    history, due, _, last = daily(spark, sf_dir)
    return S.append_daily(history, due, last)


def daily(spark, sf_dir):
    """History, fresh rows that may be appended, refused ones, and the checkpoint; every 15th comes twice."""
    rows = V.obs(spark, sf_dir)
    history = rows.filter(F.col("day") <= "2000-12-31")
    fresh = rows.filter(F.col("day") >= "2000-06-01").withColumn("listed", F.col("listed") + 1)
    twice = fresh.filter(F.col("day").endswith("-15")).withColumn("listed", F.col("listed") + 1)
    last = history.agg(F.max("day")).scalar()
    return history, *S.due_daily(history, fresh.unionByName(twice), last), last


@bound(
    "daily_append_refused",
    """WITH f AS (SELECT day, CASE WHEN day LIKE '%-15' THEN 2 ELSE 1 END AS n FROM obs WHERE day >= '2000-06-01')
       SELECT day, n::BIGINT AS n, CASE WHEN day <= (SELECT max(day) FROM obs WHERE day <= '2000-12-31')
              THEN 'not later than the checkpoint' ELSE 'more than one row' END AS reason
       FROM f WHERE n > 1 OR day <= (SELECT max(day) FROM obs WHERE day <= '2000-12-31')""",
)
def _(spark, sf_dir):
    return daily(spark, sf_dir)[2]


@bound(
    "daily_guard",
    """SELECT true AS history_matches_checkpoint, true AS checkpoint_not_in_future, true AS one_row_per_day, 1::BIGINT AS set
       UNION ALL SELECT false, false, false, 2""",
)
def _(spark, sf_dir):
    """The guard over a sound history, then over one with a repeated day and a checkpoint ahead of it."""
    history, _, _, last = daily(spark, sf_dir)
    sound = S.daily_guard(history, last, last).withColumn("set", F.lit(1).cast("bigint"))
    broken = history.unionByName(history.filter(F.col("day").endswith("-01")))
    return sound.unionByName(S.daily_guard(broken, F.lit("2001-06-30"), last).withColumn("set", F.lit(2).cast("bigint")))


@bound(
    "dq_series",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY day) AS place FROM obs),
            b AS (SELECT *, lag(day) OVER (ORDER BY place) AS d FROM
                  (SELECT day, CASE WHEN place = 7 THEN 3.5 ELSE place END AS place FROM o
                   UNION ALL SELECT day, place + 0.2 FROM o WHERE day LIKE '%-01'))
       SELECT 1::BIGINT AS set, count(*) AS n, count(DISTINCT day) AS distinct_days, min(day) AS first_day,
              max(day) AS last_day, 0::BIGINT AS out_of_order, true AS ok FROM obs
       UNION ALL SELECT 2, count(*), count(DISTINCT day), min(day), max(day), count(*) FILTER (d >= day), false FROM b""",
)
def _(spark, sf_dir):
    """A sound series, then one with a row out of place and repeated days."""
    whole = Window.orderBy("day")  # one row per day
    placed = V.obs(spark, sf_dir).select("day", F.row_number().over(whole).cast("double").alias("place"))
    moved = placed.withColumn("place", F.when(F.col("place") == 7, 3.5).otherwise(F.col("place")))
    broken = moved.unionByName(placed.filter(F.col("day").endswith("-01")).withColumn("place", F.col("place") + 0.2))
    rules = [S.series_rules(x, "day", "place").withColumn("set", F.lit(i).cast("bigint")) for i, x in enumerate((placed, broken), 1)]
    return rules[0].unionByName(rules[1])
