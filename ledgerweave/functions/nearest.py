"""Searches along the numbered rows of a key without pairs: the next row that reaches a value, and the highest row of a range.

The rows of a key are cut into blocks of ``size`` numbers, one row each, blocks into blocks of blocks, and so on; a block knows
its highest value. A search looks at the rest of its own block, then at the rest of the block above, until some block reaches
the value, and from there down to the row. So a search is one row a level, up and down, and compares with at most ``size``
values at each; nothing is joined with a range, and log(rows) / log(size) levels suffice.

Numbers start at 0 for each key and have no gap. Values and thresholds are long, without NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.session import settled

SIZE = 256


class Blocks:
    """Levels of blocks over ``rows`` with the columns ``key, n, value``."""

    def __init__(self, rows: DataFrame, key: str, n: str, value: str, size: int = SIZE):
        self.key, self.size = key, size
        level = rows.select(F.col(key), F.col(n).cast("bigint").alias("_n"), F.col(value).cast("bigint").alias("_v"))
        self.levels: list[DataFrame] = []
        while True:
            block = level.groupBy(key, F.expr(f"_n div {size}").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_n", "_v"))).alias("_rows"))
            values = settled(block.select(key, "_block", F.transform("_rows", lambda r: r["_v"]).alias("_values")))
            self.levels.append(values)
            if values.filter("_block > 0").isEmpty():
                return
            level = values.select(key, F.col("_block").alias("_n"), F.array_max("_values").alias("_v"))

    def _at(self, searches: DataFrame, level: int) -> DataFrame:
        """Searches with the values of their block at a level, empty beyond the last."""
        found = searches.withColumn("_block", F.expr(f"_at div {self.size}")).join(self.levels[level], [self.key, "_block"], "left")
        return found.withColumn("_values", F.coalesce("_values", F.array().cast("array<bigint>")))

    def first_at_least(self, searches: DataFrame, start: Column, least: Column, name: str) -> DataFrame:
        """Add ``name``: the smallest number from ``start`` on whose value is at least ``least``, NULL if there is none."""
        return self._search(searches, start, least, name, forward=True)

    def last_at_least(self, searches: DataFrame, start: Column, least: Column, name: str) -> DataFrame:
        """Add ``name``: the greatest number up to ``start`` (which may be -1) whose value is at least ``least``."""
        return self._search(searches, start, least, name, forward=False)

    def _search(self, searches: DataFrame, start: Column, least: Column, name: str, forward: bool) -> DataFrame:
        columns = searches.columns
        kept = [F.col(c) for c in columns]
        up = searches.select(*kept, start.cast("bigint").alias("_at"), least.cast("bigint").alias("_least"), F.lit(None).cast("bigint").alias("_hit"), F.lit(None).cast("int").alias("_level"))
        place = F.col("_at") - F.col("_block") * self.size
        fits = lambda v, i: (v >= F.col("_least")) & (F.lit(True) if forward else i <= place)
        end = F.array_min if forward else F.array_max
        for level in range(len(self.levels)):
            # Not found yet: the rest of this block, then the neighbours of the block one level up.
            here = self._at(up, level)
            reach = F.filter(F.transform("_values", lambda v, i: F.when(fits(v, i) & ((i >= place) if forward else F.lit(True)), i.cast("bigint"))), lambda i: i.isNotNull())
            got = F.when(F.col("_hit").isNull() & (F.col("_at") >= 0), end(reach) + F.col("_block") * self.size)
            here = here.withColumn("_got", got)
            step = F.col("_block") + (1 if forward else -1)
            up = here.select(
                *kept,
                "_least",
                F.coalesce("_hit", "_got").alias("_hit"),
                F.when(F.col("_hit").isNotNull(), F.col("_level")).when(F.col("_got").isNotNull(), level).alias("_level"),
                F.when(F.coalesce("_hit", "_got").isNotNull(), F.col("_at")).when(F.col("_at") < 0, -1).otherwise(step).alias("_at"),
            )
        down = up
        for level in range(len(self.levels) - 2, -1, -1):
            # A hit above this level is a block of this level: its first or last value that reaches.
            deep = settled(down.select(*kept, "_least", "_hit", "_level"))
            inner = deep.filter(F.col("_level") > level).withColumn("_block", F.col("_hit")).join(self.levels[level], [self.key, "_block"])
            reach = F.filter(F.transform("_values", lambda v, i: F.when(v >= F.col("_least"), i.cast("bigint"))), lambda i: i.isNotNull())
            moved = inner.select(*kept, "_least", (end(reach) + F.col("_block") * self.size).alias("_hit"), F.col("_level"))
            down = deep.filter(F.coalesce(F.col("_level") <= level, F.lit(True))).unionByName(moved)
        return down.select(*kept, F.col("_hit").alias(name))

    def first_highest(self, searches: DataFrame, ident: list[str], low: Column, high: Column, name: str) -> DataFrame:
        """Add ``name``: the smallest number with the highest value from ``low`` to below ``high``, NULL for an empty range.

        ``ident`` names the columns that tell searches apart. A range is a part of a block at either end of each level, and the
        whole blocks between belong to the level above.
        """
        parts = searches.select(self.key, *ident, low.cast("bigint").alias("_a"), high.cast("bigint").alias("_b")).filter("_a < _b")
        best = None
        for level in range(len(self.levels)):
            first, last = F.expr(f"_a div {self.size}"), F.expr(f"(_b - 1) div {self.size}")
            top = level + 1 == len(self.levels)
            one = first == last
            left = F.struct(F.col("_a").alias("_at"), F.least(F.col("_b"), (first + 1) * self.size).alias("_to"))
            right = F.struct((last * self.size).alias("_at"), F.col("_b").alias("_to"))
            cut = parts.withColumn("_cut", F.explode(F.when(one, F.array(left)).otherwise(F.array(left, right))))
            seen = self._at(cut.select(self.key, *ident, "_cut.*"), level)
            base = F.col("_block") * self.size
            inside = F.slice("_values", (F.col("_at") - base + 1).cast("int"), (F.col("_to") - F.col("_at")).cast("int"))
            high_value = F.array_max(inside)
            at = F.col("_at") + F.array_position(inside, high_value) - 1
            found = seen.select(self.key, *ident, F.struct(high_value.alias("v"), (-at).alias("m"), F.lit(level).alias("level")).alias("_best"))
            best = found if best is None else best.unionByName(found)
            if top:
                break
            parts = settled(parts.filter(last > first + 1).select(self.key, *ident, (first + 1).alias("_a"), last.alias("_b")))
        # Of equal values the leftmost counts, and numbers of different levels are compared by the rows below them.
        starts = F.expr("-_best.m") * F.pow(F.lit(self.size), F.col("_best.level")).cast("bigint")
        ranked = best.select(self.key, *ident, F.struct(F.col("_best.v").alias("v"), (-starts).alias("s"), F.col("_best.level").alias("level"), F.col("_best.m").alias("m")).alias("_best"))
        last_best = ranked.groupBy(self.key, *ident).agg(F.max("_best").alias("_best"))
        rows = last_best.select(self.key, *ident, F.col("_best.v").alias("_v"), F.col("_best.level").alias("_level"), (-F.col("_best.m")).alias("_m"))
        if len(self.levels) > 1:
            rows = settled(rows)
        for level in range(len(self.levels) - 2, -1, -1):
            inner = rows.filter(F.col("_level") > level).withColumn("_block", F.col("_m")).join(self.levels[level], [self.key, "_block"])
            moved = inner.select(self.key, *ident, "_v", F.lit(level).alias("_level"), (F.array_position("_values", F.col("_v")) - 1 + F.col("_block") * self.size).alias("_m"))
            rows = settled(rows.filter(F.col("_level") <= level).unionByName(moved))
        # Ends of a range may be no ordinary numbers; key columns are compared as they are.
        return searches.join(rows.select(self.key, *ident, F.col("_m").alias(name)), [self.key, *ident], "left")
