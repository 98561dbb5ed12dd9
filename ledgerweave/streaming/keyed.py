"""Keyed stream without a state processor: the last movement of every asset as a streaming aggregate of built-in functions.

It has no cursors and no statuses; ``streaming.gate`` has both. The state is the maximum by (seq, tx) and a sticky burn flag,
so it does not depend on the order of arrival, needs no Python, and rows of a busy asset collapse before the shuffle. Two
transactions at the last sequence number of an asset are a conflict, and ``agreed`` fails the micro-batch; at an earlier number
they are not seen. Ids may be of any type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConflictingMoves(RuntimeError):
    """Two transactions claim one sequence number of an asset."""


def keyed_state(moves: DataFrame, fields: list[str]) -> DataFrame:
    """Streaming frame of state rows. Input: asset, seq, tx, burns and the state ``fields``."""
    last = F.max(F.struct("seq", "tx", *fields))
    # The smallest and largest mark of an id at the last sequence number, each as a maximum by (seq, mark).
    mark = F.shiftright(F.xxhash64("tx"), 1)
    low, high = (F.max(F.struct("seq", m.alias("n"))) for m in (-mark, mark))
    state = moves.groupBy("asset").agg(
        last.alias("_s"), low.alias("_l"), high.alias("_h"), F.max("burns").alias("burned"), F.count(F.lit(1)).alias("seen")
    )
    return state.select(
        "asset",
        "_s.seq",
        "_s.tx",
        *[f"_s.{c}" for c in fields],
        "burned",
        "seen",
        (F.col("_h.n") != -F.col("_l.n")).alias("conflict"),
    )


def agreed(states: DataFrame) -> DataFrame:
    """The micro-batch's states, if no asset is in conflict."""
    bad = states.filter("conflict").select("asset").limit(5).collect()
    if bad:
        raise ConflictingMoves(", ".join(str(r["asset"]) for r in bad))
    return states.drop("conflict")
