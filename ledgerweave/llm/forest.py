"""Subtree sums over a forest of any shape by centroid decomposition.

A component of the forest is split at its centroid, the deepest node that holds more than half of the component's nodes below
itself. The totals of the centroid and of the components under it are summed and added to every node on the path from the
centroid up to the component's top; those are just the nodes that hold more than half, so the path needs no walk. What hangs
under the centroid and what is left above it are components of at most half the size and are split the same way. A node is
visited once for each halving, so a chain costs no more than a bush.

A forest is first cut into pieces of bounded size. An edge is cut where parent and child lie in different bands, ``size`` div
``width`` (``size``: nodes of the whole subtree). Below the first band a piece is a whole subtree of fewer than ``width``
nodes. In a higher band two children of one node cannot share its band, so a piece is a path whose sizes differ by less than
``width``. Whole subtrees give their total to the node they hang from. The paths, at most about three for each ``width`` nodes
of the forest, form a smaller forest of their own, which is cut with a width that is larger by the factor ``PIECE``, and so
on; its sums come back to the nodes the paths hang from. Then each piece is decomposed alone, inside a task. So there are
log(nodes) / log(PIECE) rounds, a task holds a few pieces, and a node with very many children is met by sums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import written
from ledgerweave.llm.graph import _rooted

PIECE = 1 << 16
HOT = 1000  # a key is hot if it holds more than one in so many rows, so there are fewer hot keys than that


def join_one(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a ``table`` of one row for each key, where some keys may hold a large part of ``rows``.

    Rows of hot keys meet a broadcast part of the table, of fewer than ``HOT`` rows; the others are shuffled. ``rows`` is read
    several times, so it should be a written table.
    """
    n = rows.count()
    hot = F.broadcast(written(rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") * HOT > n).select(key), "hot"))
    few = table.join(hot, key, "left_semi")
    spread = rows.join(hot, key, "left_semi").join(F.broadcast(few), key, "left")
    return spread.unionByName(rows.join(hot, key, "left_anti").join(table, key, "left"))


def centroid_sums(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one row a node) over each node's subtree; ``parent`` is a place, or -1 for a top."""
    m = len(parent)
    up = np.where(parent < 0, np.arange(m), parent)
    depth, jump = (parent >= 0).astype(np.int64), up
    while (jump != (further := jump[jump])).any():
        depth, jump = depth + depth[jump], further
    # Nodes below each node, and its place in depth-first order.
    order, above = np.argsort(depth, kind="stable").tolist(), parent.tolist()
    whole = [1] * m
    for v in reversed(order):
        if above[v] >= 0:
            whole[above[v]] += whole[v]
    place, free, at = [0] * m, [0] * m, 0
    for v in order:
        if above[v] < 0:
            place[v], at = at, at + whole[v]
        else:
            place[v] = free[above[v]]
            free[above[v]] += whole[v]
        free[v] = place[v] + 1
    pre, end = np.array(place), np.array(place) + np.array(whole)
    size, label = np.array(whole), jump
    sums = np.zeros_like(values)
    left = np.arange(m)
    centre = np.full(m, -1)
    while len(left):
        over = left[2 * size[left] > size[label[left]]]
        by_comp = np.lexsort((size[over], label[over]))
        first = np.concatenate([[True], np.diff(label[over][by_comp]) != 0])
        cut = over[by_comp][first]
        centre[label[cut]] = cut
        own = centre[label[left]]
        below = left[(pre[left] > pre[own]) & (pre[left] < end[own])]
        kids = below[parent[below] == centre[label[below]]]
        # A node below belongs to the child of its centroid that comes last before it.
        key = lambda v: label[v] * (m + 1) + pre[v]
        kids = kids[np.argsort(key(kids))]
        under = kids[np.searchsorted(key(kids), key(below), side="right") - 1] if len(kids) else below
        totals = np.zeros_like(values)
        np.add.at(totals, under, values[below])
        totals[cut] = values[cut]
        np.add.at(totals, parent[kids], totals[kids])
        met = centre[label[over]]
        sums[over] += totals[met]
        shrink = size[met]
        size[over] -= shrink
        label[below] = under
        left = left[left != own]
    return sums


def _summed(values: list[str]):
    out = lambda names, sums: pa.record_batch([names, *(pa.array(c, pa.int64()) for c in sums.T)], names=["node", *values])

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        nodes = table.column("node").to_pylist()
        at = {x: i for i, x in enumerate(nodes)}
        ups = zip(nodes, table.column("parent").to_pylist(), table.column("top").to_pylist(), strict=True)
        parent = np.array([-1 if node == top else at[up] for node, up, top in ups], np.int64)
        return out(table.column("node").combine_chunks(), centroid_sums(parent, np.stack([table.column(v).to_numpy() for v in values], axis=1)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by piece; whole pieces are taken together up to the size of one."""
        held: list[pa.RecordBatch] = []
        n, last = 0, None
        for part in parts:
            tops = part.column("top").to_pylist()
            start = 0
            for i, top in enumerate(tops):
                if top != last and n + i - start >= PIECE:
                    held.append(part.slice(start, i - start))
                    yield done([h for h in held if h.num_rows])
                    held, n, start = [], 0, i
                last = top
            held.append(part.slice(start))
            n += len(tops) - start
        if n:
            yield done([h for h in held if h.num_rows])

    return run


def _plus(rows: DataFrame, extra: DataFrame, values: list[str]) -> DataFrame:
    """Add what hangs from nodes; ``extra`` has one row a node."""
    named = extra.select(F.col("attach").alias("node"), *[F.col(v).alias(f"_{v}") for v in values])
    return rows.join(named, "node", "left").select("node", "parent", "size", "top", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])


def _rolled(rows: DataFrame, values: list[str], width: int, piece: int) -> DataFrame:
    add = [F.sum(v).alias(v) for v in values]
    above = rows.select(F.col("node").alias("parent"), F.col("size").alias("_above"))
    banded = join_one(rows, above, "parent")
    inner = written(banded.filter(F.expr(f"size div {width} = _above div {width}")).select("node", "parent"), "inner")
    tops = _rooted(inner).select("node", F.col("parent").alias("_top"))
    labelled = written(rows.join(tops, "node", "left").select("node", "parent", "size", F.coalesce("_top", "node").alias("top"), *values), "labelled")
    light, heavy = labelled.filter(F.col("size") < width), labelled.filter(F.col("size") >= width)
    attach = F.max(F.when(F.col("node") == F.col("top"), F.col("parent"))).alias("attach")
    pieces = light
    if not heavy.isEmpty():
        hung = light.groupBy("top").agg(attach, *add).filter("attach IS NOT NULL").groupBy("attach").agg(*add)
        heavy = written(_plus(heavy, hung, values), "heavy")
        paths = heavy.groupBy("top").agg(attach, F.max("size").alias("size"), *add)
        owner = heavy.select(F.col("node").alias("attach"), F.col("top").alias("parent"))
        smaller = written(paths.join(owner, "attach", "left").select(F.col("top").alias("node"), "parent", "size", "attach", *values), "paths")
        full = smaller.select("node", *values)
        if not smaller.filter("parent IS NOT NULL").isEmpty():
            full = _rolled(smaller.drop("attach"), values, width * piece, piece)
        hung = smaller.filter("attach IS NOT NULL").select("node", "attach").join(full, "node").groupBy("attach").agg(*add)
        pieces = light.unionByName(_plus(heavy, hung, values))
    together = pieces.repartition("top").sortWithinPartitions("top")
    kind = rows.schema["node"].dataType.simpleString()
    return written(together.mapInArrow(_summed(values), f"node {kind}, " + ", ".join(f"{v} long" for v in values)), "rolled")


def rollup(nodes: DataFrame, values: list[str], piece: int | None = None) -> DataFrame:
    """``node`` and the sums of ``values`` over its subtree, itself included.

    ``nodes``: ``node`` (unique, not NULL), ``parent`` (NULL for a top), ``size`` (nodes of its subtree) and the columns
    ``values`` as long. An empty forest has no rows.
    """
    piece = piece or PIECE
    rows = written(nodes.select("node", "parent", F.col("size").cast("long").alias("size"), *[F.col(v).cast("long").alias(v) for v in values]), "forest")
    return _rolled(rows, values, piece, piece)
