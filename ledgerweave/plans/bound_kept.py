"""Products kept up to date: an opening build and two batches; each figure must equal that of the full build.

The batches take changed assets with their rows before and after, and sales that the ledger lacks. The second brings late sales of the
base ledger, which change months, buyers and first sales that the opening has counted; the third brings the live ones.
"""

from pyspark.sql import functions as F

from ledgerweave.operators import kept as K
from ledgerweave.operators import wallets as W
from ledgerweave.plans import views as V
from ledgerweave.plans.bound_market import PRICE, ROYALTY
from ledgerweave.plans.bound_stream import workspace
from ledgerweave.plans.once import built_once
from ledgerweave.plans.registry import ORACLES, bound
from ledgerweave.session import settled, spool
from ledgerweave.sources.positions import append_ordered, read_positions, read_ranges

TURNS = ["1996-01-01", "1998-03-01", "2100-01-01"]
TABLES = ["lineitem", "orders", "part"]
STATE = ["owner", "burned", "burn_ts", "locked", "activity_ts"]
SALE = ["tx", "asset", "buyer", "ts", "price", "royalty"]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def turn_ends(lines):
    """The greatest line of each asset in each turn, in one pass over the lines; NULL where the turn has none."""
    turn = sum((F.col("ts") >= ntz(t)).cast("int") for t in TURNS)
    return lines.groupBy("asset").agg(*[F.max(F.when(turn == i, V.line_order())).alias(f"_{i}") for i in range(len(TURNS))])


def batch_changes(spark, sf_dir, ends, turn):
    """Assets with sales between two instants, as they were and as they are; all assets at the opening."""

    def upto(i):
        last = F.greatest(*[f"_{k}" for k in range(i + 1)]) if i else F.col("_0")
        rows = V.state_of(spark, sf_dir, ends.select("asset", last.alias("_last"), F.col(f"_{turn}").isNotNull().alias("_sold")))
        return (rows.filter("_sold") if turn else rows).drop("_sold")

    return K.signed_changes(upto(turn - 1) if turn else None, upto(turn))


def batch_sales(spark, sf_dir, lines):
    base, live = V.base(spark, sf_dir, lines), V.live(spark, sf_dir, lines)
    late = F.col("tx") % 3 == 0
    fresh = live.join(base.select("tx", "asset"), ["tx", "asset"], "left_anti")
    parts = [base.filter(~late), base.filter(late), fresh]
    return [p.withColumns({"origin": ntz(V.ORIGIN), "opening": F.lit(i < 2)}) for i, p in enumerate(parts)]


def build(spark, sf_dir):
    """Lines are joined once and held compressed, with the columns that are read; so is each batch, which is read several times."""
    root = f"{workspace(spark, 'kept')}/tables"
    with spool(spark) as keep:
        lines = keep(V.sale_lines(spark, sf_dir))
        ends = keep(turn_ends(lines))
        for turn, sales in enumerate(batch_sales(spark, sf_dir, lines)):
            changes = batch_changes(spark, sf_dir, ends, turn).select("asset", "category", *STATE, "sign")
            K.refresh(spark, root, keep(changes), keep(sales.select(*SALE, "origin", "opening")), "batches", turn)
    return root


def tables(spark, sf_dir):
    return built_once(spark, sf_dir, TABLES, build)


def kept(name, full):
    """Register a query whose rows must equal those of the full build ``full``."""
    ORACLES[name] = ORACLES[full]
    return bound(name)


@kept("kept_state_kpis", "state_kpis")
def _(spark, sf_dir):
    return K.kept_state_kpis(spark, tables(spark, sf_dir), V.clock(spark, sf_dir))


@kept("kept_holder_balances", "holder_balances")
def _(spark, sf_dir):
    return K.kept_holder_balances(spark, tables(spark, sf_dir)).withColumn("owner", F.col("owner").cast("bigint"))


@kept("kept_holder_tiers", "holder_tiers")
def _(spark, sf_dir):
    return K.kept_holder_tiers(spark, tables(spark, sf_dir))


@kept("kept_activity_buckets", "activity_buckets")
def _(spark, sf_dir):
    return K.kept_activity_buckets(spark, tables(spark, sf_dir), V.clock(spark, sf_dir))


@kept("kept_burned_by_category", "burned_by_rarity")
def _(spark, sf_dir):
    return K.kept_burned_by_category(spark, tables(spark, sf_dir), V.CATEGORIES)


@kept("kept_burn_history", "burn_history")
def _(spark, sf_dir):
    return K.kept_burn_history(spark, tables(spark, sf_dir), V.clock(spark, sf_dir))


@kept("kept_market_kpis", "market_kpis")
def _(spark, sf_dir):
    return K.kept_market_kpis(spark, tables(spark, sf_dir), F.lit(14850.0), PRICE, ROYALTY)


@kept("kept_monthly_activity", "monthly_activity")
def _(spark, sf_dir):
    return K.kept_monthly_activity(spark, tables(spark, sf_dir), PRICE, ROYALTY)


@kept("kept_daily_activity", "daily_activity")
def _(spark, sf_dir):
    return K.kept_daily_activity(spark, tables(spark, sf_dir), PRICE)


@kept("kept_first_resale", "first_resale")
def _(spark, sf_dir):
    return K.kept_first_resale(spark, tables(spark, sf_dir))


BY_PLACE = ["ts", "tx", "asset"]
SMALL_RANGE = 1 << 14  # many ranges on small inputs


def build_positions(spark, sf_dir):
    """Sales in three batches: most, then late ones spread over all times together with rows that are stored already."""
    root = f"{workspace(spark, 'positions')}/tables"
    sales = settled(V.sales(spark, sf_dir).select("tx", "asset", "ts", "buyer", "seller", "price"))
    late, month = F.col("tx") % 50 == 0, F.expr("year(ts) * 12 + month(ts)")
    recent = F.col("ts") >= ntz(TURNS[1])
    for turn, part in enumerate([sales.filter(~recent & ~late), sales.filter(~recent & (late | (F.col("tx") % 7 == 0))), sales.filter(recent)]):
        append_ordered(spark, root, part, BY_PLACE, month, SMALL_RANGE, {"wallets": W.wallet_places}, "sales", turn)
    return root


def ordered(spark, sf_dir):
    return built_once(spark, sf_dir, TABLES, build_positions)


@kept("kept_row_index", "row_index")
def _(spark, sf_dir):
    return read_positions(spark, ordered(spark, sf_dir)).select("tx", "asset", "idx")


@bound("kept_position_page", "SELECT idx, tx, asset, buyer, seller, price FROM sales_idx WHERE idx BETWEEN 2000 AND 2099")
def _(spark, sf_dir):
    """A page of positions: the ranges that hold it are read, no others."""
    return read_positions(spark, ordered(spark, sf_dir), 2000, 2099).select("idx", "tx", "asset", "buyer", "seller", "price")


ORACLES["kept_wallet_lists"] = f"SELECT * FROM ({ORACLES['wallet_index']}) WHERE kind IN ('buy', 'sell')"


@bound("kept_wallet_lists")
def _(spark, sf_dir):
    index = W.placed_index(read_ranges(spark, ordered(spark, sf_dir), "wallets"))
    return index.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))
