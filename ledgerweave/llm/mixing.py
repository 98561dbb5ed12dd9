"""Mixing sources to target weights with a multivariate hypergeometric splitting tree.

Sources in code-point order (NULL last) weigh 3, 1, 2, 3, 1, 2, ... and share 150 % of all words; a target is cut at twice
its source's words and the excess is shared again by weight. Documents are cut into blocks of words. A source's stream is
its blocks in a pseudo-random permutation, one permutation for each pass over the source: whole passes first, then the
first blocks of one more pass until the target is reached to the nearest block. That fixes an exact quota of blocks for
each source. A binary tree splits the quotas among output shards: at each node the left half's share of every source is a
multivariate hypergeometric draw, so each shard is a random sample of the mix and the quotas add up exactly. A shard takes
its quota of each source as a range of the stream, disjoint from all other shards, and is shuffled on its own.

All draws come from hashes of ids, so reruns agree. Work on a source is cut by ranges of the permutation; no task holds a
whole source.

Defined results: NULL or empty text has no words and nothing is taken of it; rows with a repeated or NULL doc_id are mixed
row by row; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerweave.functions.ordered import dense_index, exclusive_prefix
from ledgerweave.llm.common import WORD, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST = 2  # times a source's words
BLOCK_WORDS = 256
SHARD_WORDS = 1 << 20
SEED = 11
_FINE = 12  # the permutation is cut into 2 ** _FINE ranges for each source and pass


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, size`` rows. One row a source; scalars alone reach the driver."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    ranked = dense_index(by, ["_last", "source"], "place").drop("_last")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double")
    table = written(ranked.select("source", "place", "source_size", weight.alias("weight")), "sources")
    left = SHARE * (table.agg(F.sum("source_size")).first()[0] or 0)
    # A source is full if the level (words for one unit of weight) times its weight is over its limit. Filling one source
    # only raises the level for the others, so the full ones are found in a few rounds.
    limit = (MOST * F.col("source_size")).cast("double")
    level = 0.0
    full = F.lit(False)
    while True:
        room, used = table.filter(~full).agg(F.sum("weight")).first()[0], table.filter(full).agg(F.sum(limit)).first()[0] or 0.0
        if not room:
            break
        level = (left - used) / room
        over = F.col("weight") * F.lit(level) > limit
        if table.filter(over & ~full).isEmpty():
            break
        full = full | over
    return table.withColumn("target", F.when(full, limit).otherwise(F.col("weight") * F.lit(level)))


def _draw(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Hypergeometric draw; beyond the library's range of 1e9 by its normal limit, kept within what is possible."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total = good + bad
    mean = n * good / total
    spread = np.sqrt(max(mean * bad / total * (total - n) / (total - 1), 0.0))
    return int(min(max(round(rng.normal(mean, spread)), n - bad, 0), good, n))


def split(quotas: list[int], left_share: float, rng: np.random.Generator) -> tuple[list[int], list[int]]:
    """Left and right quotas of a node. The left child gets its exact share of all blocks, dealt by chance to sources."""
    n, rest = round(sum(quotas) * left_share), sum(quotas)
    left = []
    for q in quotas:
        rest -= q
        left.append(_draw(q, rest, n, rng))
        n -= left[-1]
    return left, [q - x for q, x in zip(quotas, left, strict=True)]


def _grow(levels: int):
    """Splits each node ``levels`` times, or until it is one shard."""
    schema = pa.schema([("first", pa.int64()), ("shards", pa.int64()), ("quotas", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            todo = [(f, s, q, 0) for f, s, q in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            rows = []
            while todo:
                first, shards, quotas, depth = todo.pop()
                if shards == 1 or depth == levels:
                    rows.append((first, shards, quotas))
                    continue
                half = shards // 2
                left, right = split(quotas, half / shards, np.random.default_rng((SEED, first, shards)))
                todo += [(first, half, left, depth + 1), (first + half, shards - half, right, depth + 1)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def shard_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """``shard, place, start, stop``: the range of each source's stream that each shard takes.

    ``quotas``: ``place, quota``, one row a source. The tree grows ten levels at a time; each new node is a row of its own.
    """
    listed = quotas.agg(F.sort_array(F.collect_list(F.struct("place", "quota"))).alias("q"))  # one entry a source
    nodes = listed.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("shards"), F.col("q.quota").alias("quotas"))
    depth = 0
    while depth == 0 or 1 << depth < shards:
        nodes = nodes.mapInArrow(_grow(10), "first long, shards long, quotas array<long>")
        depth += 10
        if 1 << depth < shards:
            nodes = nodes.repartition("first")
    per = nodes.select(F.col("first").alias("shard"), F.posexplode("quotas").alias("place", "n"))
    before = exclusive_prefix(per.withColumn("place", F.col("place").cast("long")), ["place"], ["shard"], F.shiftright("shard", 12), sums={"start": F.col("n")})
    return before.filter("n > 0").select("shard", "place", "start", (F.col("start") + F.col("n")).alias("stop"))


def mix(sized: DataFrame, block_words: int | None = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Targets, and the mix: ``shard, spot, row, pass, block, n_words`` with ``spot`` the place in the shuffled shard.

    ``sized``: ``row`` (unique), ``doc_id``, ``source``, ``size``, pinned. ``block_words`` None takes documents whole.
    """
    wanted = targets(sized)
    some = wanted.filter("source_size > 0").select(
        F.col("source").alias("_s"), "place", "source_size", "target", F.floor(F.col("target") / F.col("source_size")).alias("passes")
    )
    rows = sized.filter("size > 0").join(some, F.col("source").eqNullSafe(F.col("_s")))
    size = F.col("size") if block_words is None else F.lit(block_words)
    passes = rows.select("row", "doc_id", "size", "place", "source_size", "target", "passes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"))
    passes = passes.filter(F.col("pass") * F.col("source_size") < F.col("target"))
    blocks = passes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / size))))
    blocks = blocks.withColumn("n_words", F.least(size, F.col("size") - F.col("block") * size).cast("long"))
    blocks = blocks.withColumn("perm", F.xxhash64(F.lit(SEED), "pass", "doc_id", "size", "block"))
    ranked = exclusive_prefix(
        blocks.select("place", "pass", "perm", "row", "block", "n_words", "passes", "source_size", "target"),
        ["place", "pass"], ["perm", "row", "block"], F.shiftright("perm", 64 - _FINE), sums={"before": F.col("n_words"), "spot": F.lit(1)},
    )
    taken = ranked.filter((F.col("pass") < F.col("passes")) | (F.col("pass") * F.col("source_size") + F.col("before") + F.col("n_words") / 2 <= F.col("target")))
    taken = written(taken.select("place", "pass", "perm", "row", "block", "n_words", "spot"), "taken")
    quotas = written(taken.groupBy("place", "pass").agg(F.count(F.lit(1)).alias("n")), "quotas")
    earlier = Window.partitionBy("place").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)  # at most three passes
    bases = quotas.select("place", "pass", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    words = taken.agg(F.sum("n_words")).first()[0] or 0
    per_source = quotas.groupBy("place").agg(F.sum("n").alias("quota"))
    # Places without a quota get none; the list must hold a number for each place up to the last.
    ranges = written(shard_quotas(wanted.select("place").join(per_source, "place", "left").select("place", F.coalesce("quota", F.lit(0)).alias("quota")), max(1, -(-words // shard_words))), "ranges")
    # A range join by cells of about a shard's quota, so a block meets a few ranges only.
    cell = ranges.groupBy("place").agg(F.ceil(F.avg(F.col("stop") - F.col("start"))).cast("long").alias("cell"))
    wide = written(ranges.join(cell, "place").select("place", "shard", "start", "stop", F.explode(F.expr("sequence(start div cell, (stop - 1) div cell)")).alias("c"), "cell"), "cells")
    spots = taken.join(bases, ["place", "pass"]).withColumn("at", F.col("spot") + F.col("base")).join(cell, "place").withColumn("c", F.expr("at div cell"))
    dealt = spots.join(wide.drop("cell"), ["place", "c"]).filter("start <= at AND at < stop")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 1), "perm", "block"), "row", "block", "pass")  # a shard has a fixed size
    return wanted, dealt.select("shard", F.row_number().over(shuffled).alias("spot"), "row", "pass", "block", "n_words")


def pinned(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``row, doc_id, source, size`` (and ``extra`` columns) of every row, written once so that row numbers hold."""
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text").cast("string")).alias("size"), *(extra or []))
    return written(picked, "sized")


def taken_words(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row: what the mix takes of it, repeats counted."""
    sized = pinned(docs)
    wanted, mixed = mix(sized)
    per_row = mixed.groupBy("row").agg(F.sum("n_words").alias("taken"))
    known = written(wanted.select(F.col("source").alias("_s"), "source_size", "target"), "targets")
    rows = sized.join(per_row, "row", "left").join(known, F.col("source").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def stage_rows(docs: DataFrame) -> DataFrame:
    """``documents`` mixed by whole documents: each row as often as the mix takes it."""
    sized = pinned(docs, ["text", "lang", "n_chars"])
    _, mixed = mix(sized.select("row", "doc_id", "source", "size"), block_words=None)
    copies = mixed.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return sized.join(copies, "row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc_id", "text", "lang", "source", "n_chars")
