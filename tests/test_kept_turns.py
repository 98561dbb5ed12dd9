"""The kept build joins the lines once and takes the states of all turns from one pass."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerweave.plans import catalog  # noqa: F401  registers in order
from ledgerweave.plans import bound_kept as B
from ledgerweave.plans import views as V


def test_turns_equal_states_of_their_instants(spark, tmp_path):
    at = lambda year, day=1: dt.datetime(year, 1, day)
    orders = [(1, 7, at(1994)), (2, 8, at(1995)), (3, 9, at(1997)), (4, 7, at(1999)), (5, None, at(1999, 2)), (6, 7, None), (4, 8, at(1997, 3))]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(o, p, 5, n, 2.5, 0.1, f, s, at(1998)) for o, p, n, f, s in [
        (1, 1, 1, "R", "F"), (2, 1, 1, "A", "O"), (3, 1, 1, "N", "O"), (3, 2, 2, "R", "F"), (3, 2, 1, "R", "O"), (4, 2, 1, "A", "F"), (5, 1, 1, None, "F"), (6, 3, 1, "R", "F"), (4, None, 3, "R", "F")]]
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_tax double"
    spark.createDataFrame(lines, f"{names}, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(1, "PROMO A"), (2, None), (3, "SMALL B"), (3, "SMALL B"), (None, "LARGE C")]
    spark.createDataFrame(parts, "p_partkey bigint, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    held = V.sale_lines(spark, str(tmp_path))
    ends = B.turn_ends(held)
    assert ends._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    text = lambda df: sorted(map(repr, df.collect()))
    for turn, instant in enumerate(B.TURNS):
        before = F.col("ts") < B.ntz(instant)
        state = V.state(spark, str(tmp_path), before)
        found = B.batch_changes(spark, str(tmp_path), ends, turn)
        if turn:
            inside = before & (F.col("ts") >= B.ntz(B.TURNS[turn - 1]))
            state = state.join(held.filter(inside).select("asset").distinct(), "asset", "left_semi")
        assert text(found.filter("sign = 1").drop("sign").select(*state.columns)) == text(state)
