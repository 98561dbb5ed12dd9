"""Trie of the turn prefixes that conversations share, with subtree figures by centroid decomposition.

A node is a distinct sequence of first turns (role, text); the root is the empty sequence. Nodes are named without walking: a
turn's digest is keyed by its place, and the digests of a prefix are added up, so names come from running sums, which are
formed in chunks of a conversation. Two prefixes get one name only if 128-bit digests collide. Texts stop at their digest and
length, in the first step.

Figures that belong to a node alone are aggregates over (conversation, place) rows. The number of nodes below a node, which
cuts the forest into pieces, is such an aggregate too: the nodes whose smallest member is conversation c are the last
``owned`` nodes of c's chain, so c brings min(owned, length - depth + 1) nodes to each node it passes. Leaves and saved
characters are then summed over subtrees by ``forest.rollup``.

Skew: node and conversation keys are aggregated before they are shuffled, and lookups by a key that may be hot go through
``join_one``. The list of conversations that end at a node may be long; SHA-256 has no parallel form, so lists are prepared in
parts of 1,024 neighbouring ids and only those parts, sorted, stream through one task with constant memory.

Defined results: a NULL role or text counts as empty. Turns with one number (or none, which come first) are ordered by their
digest, and repeated rows are turns of their own. Rows without conv_id belong to no conversation. Negative ids are ids.
No conversations: no node, also no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.ordered import exclusive_prefix
from ledgerweave.llm.common import batches, written
from ledgerweave.llm.forest import join_one, rollup

CHUNK_BITS = 12  # a chunk of a conversation has 4,096 places
LANES = 4  # of 32 bits each
ID_BITS = 10  # ids that share a part of a list


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, item, chars`` of every turn: its place from 0, a digest of role and text, code points of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("item"),
        F.char_length(text).cast("long").alias("chars"),
    )
    turns = written(turns, "turns")
    chunk = F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(-(1 << 62)))
    return exclusive_prefix(turns, ["conv_id"], ["turn", "item"], chunk, sums={"pos": F.lit(1)}).select("conv_id", "pos", "item", "chars")


def _name(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes])))


def chains(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, chars``: the nodes that each conversation passes, without the root."""
    digest = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), F.hex("item")), 256)
    lanes = [F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"x{i}") for i in range(LANES)]
    keyed = written(rows.withColumn("_d", digest).select("conv_id", "pos", "chars", *lanes), "keyed")
    summed = exclusive_prefix(keyed, ["conv_id"], ["pos"], F.shiftright("pos", CHUNK_BITS), sums={f"s{i}": F.col(f"x{i}") for i in range(LANES)})
    before = [F.col(f"s{i}") for i in range(LANES)]
    after = [F.col(f"s{i}") + F.col(f"x{i}") for i in range(LANES)]
    depth = F.col("pos") + 1
    return summed.select("conv_id", depth.alias("depth"), _name(depth, after).alias("node"), _name(F.col("pos"), before).alias("parent"), "chars")


def trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of ``rows`` (``conv_id, pos, item, chars``; places from 0 without a gap), and where conversations end.

    ``convs`` has one row ``conv_id`` for each conversation, also for those without a turn. Nodes: ``node, conv_id`` (smallest
    member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``. Ends: ``node, conv_id``.
    """
    chain = written(chains(rows), "chain")
    root = _name(F.lit(0), [F.lit(0)] * LANES)
    nothing = F.unhex(F.lit(None).cast("string"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = top.select(root.alias("node"), nothing.alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars"))
    least = [F.min(c).alias(c) for c in ("parent", "conv_id", "depth")]
    inner = chain.groupBy("node").agg(*least, F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    nodes = written(inner.unionByName(top), "nodes")

    last = chain.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("last"))
    owned = nodes.filter("depth > 0").groupBy("conv_id").agg(F.count(F.lit(1)).alias("owned"))
    last = written(last.join(owned, "conv_id", "left").select("conv_id", F.col("last.depth").alias("length"), F.col("last.node").alias("node"), "owned"), "last")
    brought = join_one(chain.select("conv_id", "depth", "node"), last.filter("owned > 0").select("conv_id", "length", "owned"), "conv_id")
    sizes = brought.filter("owned IS NOT NULL").groupBy("node").agg(F.sum(F.least("owned", F.col("length") - F.col("depth") + 1)).alias("size"))
    whole = nodes.agg(F.count(F.lit(1)).alias("size")).select(root.alias("node"), "size")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(sizes.unionByName(whole), "node").join(children, "node", "left")
    full = written(full.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "sized")

    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = rollup(full.select("node", "parent", "size", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    parents = full.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = join_one(full.select("node", "parent", "conv_id", "depth", "n_convs", "n_children"), parents, "parent").drop("parent").join(sums, "node")
    ends = convs.join(last.select("conv_id", "node"), "conv_id", "left").select(F.coalesce("node", root).alias("node"), "conv_id")
    return out, ends


_DIGESTS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        node, digest = None, None
        for part in parts:
            for own, ids in zip(part.column("node").to_pylist(), part.column("ids").to_pylist(), strict=True):
                if own != node:
                    if digest is not None:
                        yield node, digest.hexdigest()
                    node, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if digest is not None:
            yield node, digest.hexdigest()

    yield from batches(_DIGESTS, rows())


def end_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of the ids that end at a node, ascending, joined by commas. Ids are unique."""
    part = ends.groupBy("node", F.shiftright("conv_id", ID_BITS).alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    text = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    listed = part.select("node", "part", text.alias("ids")).repartition("node").sortWithinPartitions("node", "part")
    return listed.mapInArrow(_hashed, "node binary, ends_sha256 string")
