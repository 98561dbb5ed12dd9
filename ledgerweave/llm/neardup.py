"""Near-duplicate classes by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles. Documents with the same set form a class at once; only
class representatives go on. Each has two small collections of ``m`` half keys, every half key made of ``ROWS`` minhashes.
Table key (i, j) joins half key i of the first collection with half key j of the second, so ``m * m`` tables cost only
``2 * m * ROWS`` minhashes. Half keys that nobody shares are dropped before the tables are formed; no table entry that
could collide is lost by that.

Entries of a table that collide point at their smallest member, never at each other. The components of that graph are
families: whatever the tables bring together is in one family. Inside families texts are compared exactly, on full sets:

* a family of at most ``BLOCK`` members is one group;
* a larger one is cut into blocks. Each block is compared inside, then all its blocks with the members that collide most
  often (hubs), and last the members outside the family's largest component with all blocks, block by block.

In a group, colliding pairs are compared most alike first and pairs that are already connected are skipped. A pair at the
threshold shares a table with probability over 0.9998 (``collections``).

Defined results: NULL, empty or blank text has an empty set, is linked with nothing and stays. Fewer words than a shingle
count as one shingle. Repeated rows are linked like copies. A row with a NULL doc_id takes no part: its component is NULL
and it stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerweave.llm.common import WordHashes, batches, windows, words_of, written
from ledgerweave.llm.graph import components

SHINGLE = 5
ROWS = 3  # minhashes of a half key
MISSED = 1e-4  # chance that a pair at the threshold has no common half key in one of the collections
BLOCK = 256  # members that are compared in one group
HUBS = 32  # members of a large family that all its blocks are compared with


def collections(percent: int) -> int:
    """Half keys in each collection."""
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z in lower case."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    ids = hashes.of([w.lower() for w in words])
    return np.unique(windows(ids, min(SHINGLE, len(ids))))


def _half_keys(found: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> list[int]:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        low = np.minimum(low, (found[at : at + 4096, None] * factors + shifts).min(axis=0))
    rows = low.reshape(-1, ROWS)
    return [xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) - (1 << 63) for i, r in enumerate(rows)]


def signed(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, d1, d2, halves``: set size, 128-bit digest of the set (NULL if empty) and both collections."""
    m = collections(percent)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("halves", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        rng = np.random.default_rng(7)
        factors = rng.integers(0, 1 << 63, 2 * m * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 1 << 63, 2 * m * ROWS, np.uint64)

        def rows():
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = shingles(text, hashes)
                    if not len(found):
                        yield doc_id, 0, None, None, None
                        continue
                    yield doc_id, len(found), *_digest(found), _half_keys(found, factors, shifts)

        yield from batches(schema, rows(), 2048)

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, halves array<long>")


def _digest(found: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(found.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def families(reps: DataFrame, m: int) -> DataFrame:
    """``node, root``: which representatives (``rep, halves``) the tables bring together, directly or over others."""
    halves = reps.select("rep", F.posexplode("halves").alias("i", "half"))
    shared = written(halves.groupBy("half").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("half"), "halves")
    some = halves.join(shared, "half", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("i", "half")).alias("h"))  # at most 2 m each
    side = lambda test: F.filter("h", lambda x: test(x["i"]))
    first, second = side(lambda i: i < m), side(lambda i: i >= m)
    pairs = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a["half"], b["half"]))))
    tables = written(some.select("rep", F.explode(pairs).alias("key")), "tables")
    first_of = written(tables.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("key", "lo"), "leaders")
    met = tables.join(first_of, "key").filter("rep <> lo")
    return components(met.select(F.col("rep").alias("a"), F.col("lo").alias("b")))


class _Union:
    """Union-find over the members of a group; members of one component so far may start together."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, i) if x is not None else i for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _compare(keys: list[str], percent: int, m: int, cross: bool):
    """Compares the rows of each group; rows come sorted by ``keys``. Emits links, and each group's busiest member.

    ``cross``: only pairs of a visiting row with another row are compared, otherwise all pairs.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("family", pa.int64()), ("hits", pa.int64())])

    def group(rows: list[dict], hashes: WordHashes) -> Iterator[tuple]:
        sets, kept = [], []
        for r in rows:
            found = shingles(r["text"], hashes)
            if len(found) and _digest(found) == (r["d1"], r["d2"]):  # else another row with the same id
                sets.append(found)
                kept.append(r)
        seen: dict[tuple, None] = {}
        order = [i for i, r in enumerate(kept) if (k := (r["rep"], r["d1"], r["visits"])) not in seen and seen.setdefault(k) is None]
        sets, kept = [sets[i] for i in order], [kept[i] for i in order]
        n = len(kept)
        if n < 2:
            return
        halves = np.array([r["halves"] for r in kept], np.int64)
        visits = np.array([r["visits"] for r in kept])
        same = [np.zeros((n, n), np.int16), np.zeros((n, n), np.int16)]
        for i in range(halves.shape[1]):
            same[i >= m] += halves[:, i, None] == halves[None, :, i]
        alike = np.where((same[0] > 0) & (same[1] > 0), same[0] + same[1], 0)
        if cross:
            alike[visits[:, None] == visits[None, :]] = 0
        np.fill_diagonal(alike, 0)
        at, to = np.nonzero(np.triu(alike))
        best = np.argsort(-alike[at, to], kind="stable")
        union = _Union([r["comp"] for r in kept])
        for i, j in zip(at[best].tolist(), to[best].tolist(), strict=True):
            x, y = union.find(i), union.find(j)
            if x != y and (kept[i]["rep"] == kept[j]["rep"] or _linked(sets[i], sets[j], percent)):
                union.join(x, y)
                yield kept[i]["rep"], kept[j]["rep"], kept[i]["family"], None
        if not cross:
            hits = np.count_nonzero(alike, axis=1)
            top = int(np.argmax(hits))
            yield kept[top]["rep"], None, kept[top]["family"], int(hits[top])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows():
            held, mine = [], None
            for part in parts:
                for r in part.to_pylist():
                    key = tuple(r[k] for k in keys)
                    if key != mine and held:
                        yield from group(held, hashes)
                        held = []
                    mine = key
                    held.append(r)
            if held:
                yield from group(held, hashes)

        yield from batches(schema, rows())

    return run


_LINKS = "a long, b long, family long, hits long"


def _links(rows: DataFrame, keys: list[str], percent: int, m: int, cross: bool) -> DataFrame:
    """Run the comparison group by group: one shuffle, then a stream over sorted rows that holds one group at a time."""
    ready = rows.repartition(*keys).sortWithinPartitions(*keys, "visits", "rep")
    return written(ready.mapInArrow(_compare(keys, percent, m, cross), _LINKS), "links")


def classes(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; linked are rows whose sets are alike by ``percent`` or more."""
    m = collections(percent)
    rows = written(signed(docs, percent, id_col, text_col), "signed")
    full = rows.filter("doc_id IS NOT NULL AND n > 0")
    reps = written(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves")), "reps")
    # Two different sets may share an id (a repeated doc_id); they are then one node of the graph.
    own = reps.groupBy("rep").agg(F.first("halves").alias("halves"), F.count(F.lit(1)).alias("k"))
    several = reps.join(own.filter("k > 1").select("rep"), "rep", "left_semi").select("rep", "halves")
    fam = families(own.filter("k = 1").select("rep", "halves").unionByName(several), m)
    sizes = fam.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = fam.join(sizes, "root").select(F.col("node").alias("rep"), F.col("root").alias("family"), "size")
    members = members.withColumn("block", F.when(F.col("size") <= BLOCK, 0).otherwise(F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / (BLOCK // 2)))))
    members = members.join(reps, "rep")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    comparable = written(texts.join(members, "rep").withColumn("comp", F.lit(None).cast("long")).withColumn("visits", F.lit(False)), "comparable")
    found = _links(comparable, ["family", "block"], percent, m, cross=False)
    links = found.filter("b IS NOT NULL").select("a", "b")
    large = comparable.filter(F.col("size") > BLOCK)
    if not large.isEmpty():
        links = links.unionByName(_across(large, found, links, percent, m))
    comps = components(links)
    # Both sides of each join are tables, so a class that holds a large part of all rows can be split between tasks.
    ids = written(reps.select("d1", "d2", "rep").join(comps.select(F.col("node").alias("rep"), "root"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("root")), "ids")
    out = rows.select("doc_id", "n", "d1", "d2").join(ids, ["d1", "d2"], "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root, F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"))


def _across(large: DataFrame, found: DataFrame, links: DataFrame, percent: int, m: int) -> DataFrame:
    """Links between blocks of large families."""
    # Hubs: one candidate a block, the busiest HUBS a family.
    order = Window.partitionBy("family").orderBy(F.desc("hits"), "rep")
    hubs = found.filter("hits > 0").select("family", F.col("a").alias("rep"), "hits").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= HUBS).select("rep", "family")
    blocks = large.select("family", "block").distinct()
    visiting = large.drop("block", "visits").join(hubs, ["family", "rep"], "left_semi").join(blocks, "family").withColumn("visits", F.lit(True))
    near = _links(large.unionByName(visiting), ["family", "block"], percent, m, cross=True).select("a", "b")
    # What is still outside its family's largest component visits all blocks.
    labels = components(links.unionByName(near)).select(F.col("node").alias("rep"), "root")
    known = large.drop("comp").join(labels, "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
    known = written(known, "known")
    sizes = known.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("n", "comp")).alias("top")).select("family", F.col("top.comp").alias("comp"))
    left = known.join(main, ["family", "comp"], "left_anti")
    if left.isEmpty():
        return near
    guests = left.withColumnRenamed("block", "guest").join(blocks, "family").withColumn("visits", F.lit(True))
    guest_blocks = left.select("family", F.col("block").alias("guest")).distinct()
    hosts = known.join(guest_blocks, "family")
    last = _links(hosts.unionByName(guests), ["family", "guest", "block"], percent, m, cross=True).select("a", "b")
    return near.unionByName(last)
