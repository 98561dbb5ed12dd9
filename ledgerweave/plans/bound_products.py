"""The product build as one job: state, sales and mints to all published documents and the wallet index, swapped together.

Documents hold figures and short lists. What has a row for each asset, mint, sale or wallet is a table beside them: assets,
mints, sales, wallet lists in pieces, lookups and rank benchmarks as runs.
"""

from pyspark.sql import functions as F

from ledgerweave.functions.scalars import iso_z, percent
from ledgerweave.operators import holders as H
from ledgerweave.operators import launch as L
from ledgerweave.operators import market as M
from ledgerweave.operators import products as P
from ledgerweave.operators import quality as Q
from ledgerweave.operators import series as S
from ledgerweave.operators import wallets as W
from ledgerweave.plans import views as V
from ledgerweave.plans.bound_market import PRICE, ROYALTY
from ledgerweave.plans.bound_state import BUCKET, mints
from ledgerweave.plans.bound_stream import workspace
from ledgerweave.plans.once import built_once
from ledgerweave.plans.registry import ORACLES, bound
from ledgerweave.session import spool
from ledgerweave.sources.tables import commit_version, read_latest

PROCEEDS = 14850.0


def build(spark, sf_dir):
    """Write all products of one version; returns their folder.

    Lines and orders are joined once. Frames are held compressed, and neither they nor shuffle files outlive the build.
    """
    with spool(spark) as keep:
        return built(spark, sf_dir, keep)


def built(spark, sf_dir, keep):
    as_of = V.clock(spark, sf_dir)
    with spool(spark) as brief:
        lines = brief(V.sale_lines(spark, sf_dir))
        states = keep(V.state_of(spark, sf_dir, lines.groupBy("asset").agg(F.max(V.line_order()).alias("_last"))))
        base, live = [keep(ledger(spark, sf_dir, lines).drop("line", "shipped")) for ledger in (V.base, V.live)]
    sales = keep(M.merge_ledgers(base, live).select("tx", "asset", "buyer", "seller", "ts", "price", "royalty", "market"))
    minted = keep(mints(spark, sf_dir))
    days = keep(V.obs(spark, sf_dir))
    assets = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("asset"), F.lit(V.ORIGIN).cast("timestamp_ntz").alias("origin")
    )
    kpis = {
        "state": H.state_kpis(states, as_of, dense=True),
        "launch": L.launch_kpis(minted, dense=True),
        "market": M.market_kpis(sales, F.lit(PROCEEDS), PRICE, ROYALTY, dense=True),
        "observation": S.latest_observation(days, "day", ["floor_units", "listed"]),
    }
    lists = {
        "state": {
            "tiers": (H.holder_tiers(states), ["ord"]),
            "activity": (H.activity_buckets(states, as_of), ["ord"]),
            "burn_history": (S.burn_history(states, as_of), ["month"]),
            "burned_by_category": (H.burned_by_category(states, V.CATEGORIES), ["ord"]),
        },
        "launch": {"phases": (L.launch_phases(minted), ["ord"]), "distribution": (L.mint_distribution(minted), ["assets_minted"])},
        "market": {
            "monthly": (M.monthly_activity(sales, PRICE, ROYALTY), ["month"]),
            "first_resale": (M.first_resale(assets, base, live), ["ord"]),
        },
        "observation": {"history": (days, ["day"])},
    }
    documents = {name: P.document(spark, {"kpis": k}, lists[name]) for name, k in kpis.items()}
    documents["summary"] = P.document(spark, kpis, {})
    documents["top_holders"] = P.document(spark, {}, {"holders": (H.top_holders(H.holder_balances(states)), ["rank", "owner"])})
    flows = sales.filter((F.col("ts") >= F.lit("1996-03-01").cast("timestamp_ntz")) & (F.col("ts") < F.lit("1999-04-01").cast("timestamp_ntz")))
    converted = S.conversion_history(flows, "1996-03-01", "1999-03-01", {"price": PRICE, "royalty": ROYALTY})
    documents["conversion"] = P.document(spark, {}, {"conversion_history": (converted, ["month"])})
    texts = None
    for name, one in documents.items():
        row = one.select(F.lit(name).alias("name"), "json")
        texts = row if texts is None else texts.unionByName(row)

    with spool(spark) as brief:  # the sorted rows, beside which the positions are counted
        sold, made = keep(W.sale_index(sales, brief)), keep(W.mint_index(minted, brief))
    codes = keep(W.dict_encode(sold.withColumn("market", F.coalesce("market", F.lit("Unknown"))), "market", ["ts", "tx", "asset"]))
    links = W.wallet_links(states, made, sold)
    bucket = F.coalesce(H.activity_bucket(F.col("locked"), F.col("activity_ts"), F.col("_as_of")), F.lit(H.NOT_LOCKED))
    code = lambda names, col: (F.array_position(F.array(*map(F.lit, names)), col) - 1).alias
    locked = F.col("locked") == 1
    asset_rows = states.withColumn("_as_of", as_of).select(
        "number",
        code(V.CATEGORIES, F.element_at(F.split("category", " "), 1))("rarity"),
        "locked",
        code([H.NOT_LOCKED, *H.ACTIVITY_LABELS], bucket)("activity"),
        F.when(locked, iso_z(F.col("lock_ts"))).alias("lock_since"),
        F.when(locked, iso_z(F.col("activity_ts"))).alias("last_activity"),
    )
    active = states.filter((F.col("burned") == 0) & F.col("owner").isNotNull())
    wallets = links.groupBy("kind").agg(F.count_distinct("wallet").alias("n"))
    known = lambda kind: wallets.agg(F.max(F.when(F.col("kind") == kind, F.col("n")))).scalar()
    collection = active.agg(F.count(F.lit(1)).alias("active_supply"), F.count_distinct("owner").alias("holders")).select(
        "active_supply",
        "holders",
        states.agg(F.count_if((F.col("burned") == 0) & locked)).scalar().alias("locked_assets"),
        made.agg(F.count(F.lit(1))).scalar().alias("public_mint_supply"),
        known("mint").alias("unique_minters"),
        known("buy").alias("unique_buyers"),
        links.agg(F.count_distinct("wallet")).scalar().alias("known_wallets"),
    )
    collection = collection.withColumn("locked_pct", percent(F.col("locked_assets"), F.col("active_supply")))
    counts = links.filter("kind <> 'sell'").groupBy("kind", "wallet").agg(F.count(F.lit(1)).alias("n"))
    root = f"{workspace(spark, 'products')}/tables"
    commit_version(
        spark,
        root,
        {
            "documents": (texts, ["name"]),
            "assets": (asset_rows, ["number"]),
            "mints": (made.select("idx", "asset", iso_z(F.col("ts")).alias("at"), code(L.PHASES, F.col("phase"))("phase")), ["idx"]),
            "sales": (
                sold.join(codes, F.coalesce(sold["market"], F.lit("Unknown")) == codes["market"]).select(
                    "idx", sold["asset"], iso_z(F.col("ts")).alias("at"), "price", "code", "tx"
                ),
                ["idx"],
            ),
            "wallets": (W.wallet_index(links), ["wallet", "kind", "piece"]),
            "lookups": (codes.select(F.lit("marketplaces").alias("name"), "code", F.col("market").alias("value")), ["name", "code"]),
            "collection": (collection, ["active_supply"]),
            "benchmarks": (W.benchmark_histogram(counts), ["kind", "n"]),
        },
    )
    return root


def part(spark, sf_dir, name):
    return read_latest(spark, built_once(spark, sf_dir, ["lineitem", "orders", "part"], build), name)


N, D, T = "bigint", "double", "string"
# Document, section, key column of a list, columns, and the query whose SQL the section must equal.
SECTIONS = [
    ("state", "kpis", None, {"active_supply": N, "holders": N, "locked_assets": N, "active_30d": N, "dormant_1y": N, "burned": N, "locked_pct": D}, "state_kpis"),
    ("state", "tiers", "tier", {"tier": T, "holder_count": N, "supply": N, "supply_pct": D}, "holder_tiers"),
    ("state", "activity", "bucket", {"bucket": T, "assets": N}, "activity_buckets"),
    ("state", "burn_history", "month", {"month": T, "monthly_burns": N, "total_burns": N}, "burn_history"),
    ("state", "burned_by_category", "category", {"category": T, "burned": N}, "burned_by_rarity"),
    ("launch", "kpis", None, {"public_mint_supply": N, "unique_minters": N, "mint_price": D, "mint_proceeds": D}, "launch_kpis"),
    ("launch", "phases", "phase", {"phase": T, "minted": N, "unique_minters": N}, "launch_phases"),
    ("launch", "distribution", "assets_minted", {"assets_minted": N, "minters": N, "total_assets": N}, "mint_distribution"),
    ("market", "kpis", None, {"secondary_sales": N, "secondary_volume": D, "unique_buyers": N, "assets_ever_sold": N, "royalties": D, "mint_plus_royalties": D}, "market_kpis"),
    ("market", "monthly", "month", {"month": T, "sales": N, "volume": D, "royalties": D}, "monthly_activity"),
    ("market", "first_resale", "bucket", {"bucket": T, "assets": N}, "first_resale"),
    ("observation", "kpis", None, {"floor_units": N, "listed": N}, "latest_observation"),
    ("top_holders", "holders", "owner", {"owner": N, "rank": N, "assets": N}, "top_holders"),
]


def section_sql(section, item, fields, source):
    numbers = [n for n, t in fields.items() if n != item and t != T]
    key = "''" if item is None else f"CAST({item} AS VARCHAR)"
    names, values = ", ".join(f"'{n}'" for n in numbers), ", ".join(f"CAST({n} AS DOUBLE)" for n in numbers)
    return f"SELECT '{section}' AS section, {key} AS item, unnest([{names}]) AS field, unnest([{values}]) AS value FROM ({ORACLES[source]})"


def register(document):
    mine = [s for s in SECTIONS if s[0] == document]
    sql = " UNION ALL ".join(section_sql(*s[1:]) for s in mine)

    def run(spark, sf_dir):
        docs = part(spark, sf_dir, "documents").filter(F.col("name") == document)
        out = None
        for _, section, item, fields, _ in mine:
            rows = P.section_rows(docs, section, fields, item)
            out = rows if out is None else out.unionByName(rows)
        return out

    bound(f"product_{document}")(run)
    ORACLES[f"product_{document}"] = sql


for _name in dict.fromkeys(s[0] for s in SECTIONS):
    register(_name)


@bound(
    "product_observations",
    "SELECT day AS item, unnest(['floor_units', 'listed']) AS field, unnest([CAST(floor_units AS DOUBLE), CAST(listed AS DOUBLE)]) AS value FROM obs",
)
def _(spark, sf_dir):
    docs = part(spark, sf_dir, "documents").filter("name = 'observation'")
    return P.section_rows(docs, "history", {"day": T, "floor_units": N, "listed": N}, "day").drop("section")


@bound(
    "product_collection",
    """SELECT *, round_even(100.0::DOUBLE * locked_assets / active_supply, 1) AS locked_pct FROM (
       SELECT (SELECT count(*) FROM state WHERE burned = 0 AND owner IS NOT NULL) AS active_supply,
              (SELECT count(*) FROM balances) AS holders, (SELECT count(*) FROM state WHERE burned = 0 AND locked = 1) AS locked_assets,
              (SELECT count(payer) FROM mints) AS public_mint_supply, (SELECT count(DISTINCT payer) FROM mints) AS unique_minters,
              (SELECT count(DISTINCT buyer) FROM merged) AS unique_buyers,
              (SELECT count(*) FROM (SELECT owner FROM balances UNION SELECT payer FROM mints WHERE payer IS NOT NULL
                UNION SELECT buyer FROM merged UNION SELECT seller FROM merged)) AS known_wallets)""",
)
def _(spark, sf_dir):
    return part(spark, sf_dir, "collection")


@bound(
    "product_assets",
    f"""SELECT number, list_position(['ECONOMY', 'STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'PROMO'], split_part(category, ' ', 1))::BIGINT - 1 AS rarity,
               locked::BIGINT AS locked,
               list_position(['Not staked', 'Active 0–7d', 'Idle 8–30d', 'Idle 31–90d', 'Idle 91–180d', 'Idle 181–365d', 'Idle 1+ year',
                 'Never quested'], CASE WHEN locked = 1 THEN {BUCKET} ELSE 'Not staked' END)::BIGINT - 1 AS activity,
               CASE WHEN locked = 1 THEN strftime(lock_ts, '%Y-%m-%dT%H:%M:%SZ') END AS lock_since,
               CASE WHEN locked = 1 THEN strftime(activity_ts, '%Y-%m-%dT%H:%M:%SZ') END AS last_activity
        FROM state""",
)
def _(spark, sf_dir):
    return part(spark, sf_dir, "assets")


@bound(
    "product_sales",
    """WITH i AS (SELECT *, row_number() OVER (ORDER BY ts, tx, asset) - 1 AS idx FROM merged),
            c AS (SELECT market, row_number() OVER (ORDER BY min(idx)) - 1 AS code FROM i GROUP BY 1)
       SELECT idx, asset, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, price, code, tx FROM i JOIN c ON c.market = i.market""",
)
def _(spark, sf_dir):
    return part(spark, sf_dir, "sales")


@bound(
    "product_mints",
    """SELECT row_number() OVER (ORDER BY ts, asset) - 1 AS idx, asset, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at,
              list_position(['Phase I', 'Phase II', 'Phase III'], phase)::BIGINT - 1 AS phase FROM mints WHERE payer IS NOT NULL""",
)
def _(spark, sf_dir):
    return part(spark, sf_dir, "mints")


def product_rules(spark, sf_dir, change=None):
    """Equality rules between the products of one version; ``change`` may spoil one of its tables first."""
    names = ("documents", "assets", "mints", "sales", "wallets", "collection", "benchmarks")
    tables = {n: part(spark, sf_dir, n) for n in names}
    if change is not None:
        tables = change(tables)
    of = lambda name, value: tables["documents"].filter(F.col("name") == name).agg(F.max(value)).scalar()
    num = lambda name, path: of(name, F.get_json_object("json", f"$.{path}").cast("double"))
    size = lambda name: tables[name].agg(F.count(F.lit(1))).scalar()
    one = lambda field: tables["collection"].agg(F.max(field)).scalar()

    def total(name, section, field, key=None, wanted=None):
        shape = f"array<struct<{field}:double" + (f",{key}:string" if key else "") + ">>"
        rows = F.from_json(F.get_json_object("json", f"$.{section}"), shape)
        kept = rows if key is None else F.filter(rows, lambda x: x[key].isin(*wanted))
        return of(name, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x[field]))

    def entry(name, section, field, at):
        rows = F.from_json(F.get_json_object("json", f"$.{section}"), f"array<struct<{field}:double>>")
        return of(name, F.element_at(rows, at)[field])

    positions = lambda *kinds: tables["wallets"].filter(F.col("kind").isin(*kinds)).agg(F.sum("n")).scalar()
    runs = lambda kind, value: tables["benchmarks"].filter(F.col("kind") == kind).agg(F.sum(value)).scalar()
    count, weight = F.col("repeats"), F.col("repeats") * F.col("n")
    labels = H.ACTIVITY_LABELS
    assets = V.table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    state = lambda field: num("state", f"kpis.{field}")
    market = lambda field: num("market", f"kpis.{field}")
    return Q.rule_report(spark, [
        ("supply and burned cover all assets", state("active_supply") + state("burned"), assets, 0),
        ("locked share", state("locked_pct"), F.round(state("locked_assets") * 100 / state("active_supply"), 1), 0.11),
        ("activity buckets cover the locked", total("state", "activity", "assets"), state("locked_assets"), 0),
        ("active are the first two buckets", state("active_30d"), total("state", "activity", "assets", "bucket", labels[:2]), 0),
        ("dormant are the last two buckets", state("dormant_1y"), total("state", "activity", "assets", "bucket", labels[-2:]), 0),
        ("categories cover the burned", total("state", "burned_by_category", "burned"), state("burned"), 0),
        ("burn history ends at the burned", entry("state", "burn_history", "total_burns", -1), state("burned"), 0),
        ("tiers cover the holders", total("state", "tiers", "holder_count"), state("holders"), 0),
        ("tiers cover the held assets", total("state", "tiers", "supply"), one("active_supply"), 0),
        ("months cover the sales", total("market", "monthly", "sales"), market("secondary_sales"), 0),
        ("months cover the volume", total("market", "monthly", "volume"), market("secondary_volume"), 0.05),
        ("first sales cover all assets", total("market", "first_resale", "assets"), assets, 0),
        ("proceeds and royalties", market("mint_plus_royalties"), market("royalties") + PROCEEDS, 1e-6),
        ("summary has the market's sales", num("summary", "market.secondary_sales"), market("secondary_sales"), 0),
        ("summary has the state's burned", num("summary", "state.burned"), state("burned"), 0),
        ("latest floor ends the history", num("observation", "kpis.floor_units"), entry("observation", "history", "floor_units", -1), 0),
        ("latest count ends the history", num("observation", "kpis.listed"), entry("observation", "history", "listed", -1), 0),
        ("collection has the holders", one("holders"), state("holders"), 0),
        ("collection has the locked", one("locked_assets"), state("locked_assets"), 0),
        ("collection has the buyers", one("unique_buyers"), market("unique_buyers"), 0),
        ("index has all assets", size("assets"), assets, 0),
        ("index has all mints", size("mints"), one("public_mint_supply"), 0),
        ("index has all sales", size("sales"), market("secondary_sales"), 0),
        ("held assets are assigned once", positions("current"), one("active_supply"), 0),
        ("mints are assigned once", positions("mint"), size("mints"), 0),
        ("holder benchmark has all holders", runs("current", count), state("holders"), 0),
        ("holder benchmark has all held assets", runs("current", weight), one("active_supply"), 0),
        ("buyer benchmark has all buyers", runs("buy", count), market("unique_buyers"), 0),
        ("buyer benchmark has all purchases", runs("buy", weight), positions("buy"), 0),
        ("mint benchmark has all minters", runs("mint", count), one("unique_minters"), 0),
        ("first of the top holders", entry("top_holders", "holders", "assets", 1), tables["benchmarks"].filter("kind = 'current'").agg(F.max("n")).scalar(), 0),
        ("locked assets of the index", tables["assets"].agg(F.sum("locked")).scalar(), state("locked_assets"), 0),
    ])


# Rules whose value SQL gets from the source tables, with that value.
COUNTED = {
    "supply and burned cover all assets": "assets",
    "activity buckets cover the locked": "locked",
    "categories cover the burned": "burned",
    "burn history ends at the burned": "burned",
    "tiers cover the holders": "holders",
    "tiers cover the held assets": "held",
    "months cover the sales": "sales",
    "months cover the volume": "volume",
    "first sales cover all assets": "assets",
    "summary has the market's sales": "sales",
    "summary has the state's burned": "burned",
    "collection has the holders": "holders",
    "collection has the locked": "locked",
    "collection has the buyers": "buyers",
    "index has all assets": "assets",
    "index has all mints": "mints",
    "index has all sales": "sales",
    "held assets are assigned once": "held",
    "mints are assigned once": "mints",
    "holder benchmark has all holders": "holders",
    "holder benchmark has all held assets": "held",
    "buyer benchmark has all buyers": "buyers",
    "buyer benchmark has all purchases": "sales",
    "mint benchmark has all minters": "minters",
    "locked assets of the index": "locked",
}
_rows = " UNION ALL ".join("SELECT '" + r.replace("'", "''") + f"' AS rule, round(CAST({v} AS DOUBLE), 2) AS value, true AS ok FROM c" for r, v in COUNTED.items())
RULES_SQL = f"""
    WITH c AS (SELECT * FROM
        (SELECT count(*) AS assets, count(*) FILTER (burned = 1) AS burned, count(*) FILTER (locked = 1) AS locked,
                count(DISTINCT owner) FILTER (burned = 0) AS holders, count(owner) FILTER (burned = 0) AS held FROM state),
        (SELECT count(*) AS sales, CAST(sum(price) AS DOUBLE) / 100.0 AS volume, count(DISTINCT buyer) AS buyers FROM merged),
        (SELECT count(payer) AS mints, count(DISTINCT payer) AS minters FROM mints))
    {_rows}"""


@bound("dq_products", RULES_SQL)
def _(spark, sf_dir):
    rows = product_rules(spark, sf_dir).filter(F.col("rule").isin(*COUNTED))
    return rows.select("rule", F.round("left", 2).alias("value"), "ok")


@bound("dq_products_ok", "SELECT 32::BIGINT AS rules, 32::BIGINT AS ok")
def _(spark, sf_dir):
    return product_rules(spark, sf_dir).agg(F.count(F.lit(1)).alias("rules"), F.count_if("ok").alias("ok"))


@bound(
    "dq_products_broken",
    """SELECT rule, false AS ok FROM (VALUES ('index has all sales'), ('held assets are assigned once'), ('buyer benchmark has all buyers'),
       ('collection has the holders'), ('months cover the sales'), ('summary has the market''s sales'), ('index has all assets')) v(rule)""",
)
def _(spark, sf_dir):
    """A version in which a sale, an asset and a buyer are lost, holders are off by one and sales are misstated."""

    def spoil(t):
        wrong = F.regexp_replace("json", '"secondary_sales":', '"secondary_sales":1')
        return t | {
            "sales": t["sales"].filter("idx > 0"),
            "assets": t["assets"].filter("number <> 0 AND number <> 1"),
            "wallets": t["wallets"].withColumn("n", F.when(F.col("kind") == "current", F.col("n") + 1).otherwise(F.col("n"))),
            "benchmarks": t["benchmarks"].withColumn("repeats", F.when((F.col("kind") == "buy") & (F.col("first_rank") == 1), 0).otherwise(F.col("repeats"))),
            "collection": t["collection"].withColumn("holders", F.col("holders") + 1),
            "documents": t["documents"].withColumn("json", F.when(F.col("name") == "market", wrong).otherwise(F.col("json"))),
        }

    watched = [
        "index has all sales", "held assets are assigned once", "buyer benchmark has all buyers", "collection has the holders",
        "months cover the sales", "summary has the market's sales", "index has all assets",
    ]
    return product_rules(spark, sf_dir, spoil).filter(F.col("rule").isin(*watched)).select("rule", "ok")
