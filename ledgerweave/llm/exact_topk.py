"""Exact top-k search by inner product: exhaustive, term at a time.

Rows and queries are sparse: a list of terms and their integer weights. A block of rows becomes an inverted index, for each
term the slots of its rows and their weights. A query scatters, term by term, its weight times the term's postings into a
dense array of scores, one for each slot; slots that share no term keep 0. A term that at least one slot in ``SPARSE`` has
is kept as a weight for each slot and added in one pass, without scattering; the sums are the same. The k highest are found by partition selection
(the k-th score, all above it, then the smallest ids with it) and merged with the best of the blocks before.

Each query has to meet each row, so both sides are dealt into a grid: queries into blocks of about ``QUERIES``, rows into
groups. A cell holds one block of queries and its running best; the rows of its group stream by in blocks of ``ROWS``. So
memory is bounded by the two sizes, a row is sent once for each block of queries, a query once for each group, and a cell
returns k rows a query whatever the size of its group. Both are dealt by a hash of the whole row: no key is hot.

Defined results: a row without terms takes part with score 0. A candidate with the query's own id is the query. Rows that
repeat an id count once, with their best score; so does a query. Ties go to the smaller id. Weights are doubles that hold
integers; where sums may leave 2^62 they are formed with unbounded integers, and a sum beyond a long counts as the nearest
long. A term that a row lists twice counts with the sum of its weights. NULL ids take no part. No queries or no rows: no result.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import written

QUERIES = 1024  # of a cell, about
ROWS = 8192  # of an index
GROUP_ROWS = 1 << 17  # of a group, about; more groups if there are fewer cells than shuffle partitions
SPARSE = 4  # slots for each posting, from which on postings are scattered
_LONGS = (-(1 << 63), (1 << 63) - 1)
_MOST = sys.float_info.max
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def sparse_rows(rows: DataFrame, id_col: str, vec_col: str, weight) -> DataFrame:
    """``id, terms, weights`` of the vectors without NULL or non-finite component; ``weight`` makes a component an integer.

    Components of weight 0 are left out.
    """
    v = F.col(vec_col).cast("array<double>")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    picked = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & usable)
    entries = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("term"), weight(x).alias("weight"))), lambda e: e["weight"] != 0)
    return picked.select("id", entries.alias("e")).select("id", F.col("e.term").alias("terms"), F.col("e.weight").alias("weights"))


def floor_of(scale: float):
    """Weight ``floor(scale * x)``, kept as a double so that no component overflows."""

    def weight(x: Column) -> Column:
        scaled = scale * x
        whole = F.floor(scaled).cast("double")
        # Beyond 2^52 a double is an integer already.
        return F.when(F.abs(scaled) < F.lit(float(1 << 52)), whole).otherwise(F.least(F.greatest(scaled, F.lit(-_MOST)), F.lit(_MOST)))

    return weight


class _Index:
    """Postings of a block of rows by term; slots are in order of the ids."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        rank = np.argsort(ids, kind="stable")
        slot = np.empty(len(ids), np.int64)
        slot[rank] = np.arange(len(ids))
        self.ids = ids[rank]
        self.first = np.flatnonzero(np.concatenate([[True], self.ids[1:] != self.ids[:-1]]))
        self.distinct = self.ids[self.first]
        owner = np.repeat(slot, np.diff(ends, prepend=0))
        order = np.lexsort((owner, terms))
        self.terms, at = np.unique(terms[order], return_index=True)
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}
        edges = [*at.tolist(), len(terms)]
        self.largest = float(np.abs(weights).max(initial=0))
        self.longest = int(np.diff(ends, prepend=0).max(initial=0))
        self.slots = [owner[order[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.weights = [weights[order[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        # A row may list a term twice; such postings are added one by one.
        self.plain = [bool((np.diff(s) > 0).all()) for s in self.slots]
        self.kind = None

    def ready(self, largest: float, terms: int) -> None:
        """Choose a number type that no sum can leave: 2^30, 2^62 or unbounded."""
        bound = self.largest * largest * max(1, min(terms, self.longest) if all(self.plain) else terms * self.longest)
        kind = np.int32 if bound < 2**30 else np.int64 if bound < 2**62 else object
        if kind is not self.kind:
            self.weights = [np.array(list(map(int, w)), object) if kind is object else w.astype(kind) for w in self.weights]
            self.kind = kind
            self.whole = [self._spread(i) if kind is not object and SPARSE * len(s) >= len(self.ids) else None for i, s in enumerate(self.slots)]

    def _spread(self, at: int) -> np.ndarray:
        """The term's weight at each slot; four bytes or eight for each of at most ``SPARSE`` times its postings."""
        out = np.zeros(len(self.ids), self.kind)
        np.add.at(out, self.slots[at], self.weights[at])
        return out

    def scores(self, terms: list[int], weights: list[float]) -> np.ndarray:
        """Best score of each distinct id."""
        out = np.zeros(len(self.ids), self.kind)
        step = np.empty_like(out)
        for term, weight in zip(terms, weights, strict=True):
            at = self.place.get(term)
            if at is None:
                continue
            if self.whole[at] is not None:
                out += np.multiply(self.whole[at], self.kind(weight), out=step)
                continue
            part = self.weights[at] * self.kind(weight) if self.kind is not object else self.weights[at] * int(weight)
            if self.plain[at]:
                out[self.slots[at]] += part
            else:
                np.add.at(out, self.slots[at], part)
        if self.kind is object:
            out = np.array([min(max(x, _LONGS[0]), _LONGS[1]) for x in out], np.int64)
        return out if len(self.distinct) == len(self.ids) else np.maximum.reduceat(out, self.first)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; of equal ones the first, so ``ids`` rise. Unordered."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


class _Cell:
    def __init__(self, k: int):
        self.k = k
        self.queries: list[tuple[int, list[int], list[float]]] = []
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = []
        self.largest, self.terms = 0.0, 0

    def ask(self, row_id: int, terms: np.ndarray, weights: np.ndarray) -> None:
        self.queries.append((row_id, terms.tolist(), weights.tolist()))
        self.best.append(None)
        self.largest, self.terms = max(self.largest, float(np.abs(weights).max(initial=0))), max(self.terms, len(terms))

    def meet(self, rows: list[pa.RecordBatch]) -> None:
        if not rows or not self.queries:
            return
        table = pa.Table.from_batches(rows)
        terms, weights = (table.column(c).combine_chunks() for c in ("terms", "weights"))
        index = _Index(table.column("id").to_numpy(), np.cumsum(np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy(), weights.flatten().to_numpy())
        index.ready(self.largest, self.terms)
        for i, (own, q_terms, q_weights) in enumerate(self.queries):
            scores, ids = index.scores(q_terms, q_weights), index.distinct
            at = int(np.searchsorted(ids, own))
            if at < len(ids) and ids[at] == own:
                scores, ids = np.delete(scores, at), np.delete(ids, at)
            keep = select(scores, ids, self.k)
            scores, ids = scores[keep].astype(np.int64), ids[keep]
            if (before := self.best[i]) is not None:
                scores, ids = np.concatenate([before[0], scores]), np.concatenate([before[1], ids])
                order = np.lexsort((scores, ids))
                scores, ids = scores[order], ids[order]
                once = np.concatenate([ids[1:] != ids[:-1], [True]])  # the last of an id is its best
                scores, ids = scores[once], ids[once]
                keep = select(scores, ids, self.k)
                scores, ids = scores[keep], ids[keep]
            self.best[i] = (scores, ids)

    def found(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.queries), 256):
            part = [(q[0], *b) for q, b in zip(self.queries[at : at + 256], self.best[at : at + 256], strict=True) if b is not None]
            if part:
                own = np.repeat([p[0] for p in part], [len(p[1]) for p in part])
                columns = [own, np.concatenate([p[2] for p in part]), np.concatenate([p[1] for p in part])]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _cells(k: int):
    """Rows come sorted by cell, in each cell queries first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, key, held, size = _Cell(k), None, [], 0
        for part in parts:
            block, group, kind = (part.column(c).to_numpy() for c in ("block", "grp", "kind"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                if key != (block[a], group[a]):
                    cell.meet(held)
                    yield from cell.found()
                    cell, key, held, size = _Cell(k), (block[a], group[a]), [], 0
                if kind[a] == 0:
                    terms, weights = part.column("terms"), part.column("weights")
                    for i in range(a, b):
                        cell.ask(part.column("id")[i].as_py(), terms[i].values.to_numpy(), weights[i].values.to_numpy())
                    continue
                while a < b:
                    n = min(b - a, ROWS - size)
                    held.append(part.select(["id", "terms", "weights"]).slice(a, n))
                    a, size = a + n, size + n
                    if size == ROWS:
                        cell.meet(held)
                        held, size = [], 0
        cell.meet(held)
        yield from cell.found()

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest scores among ``rows``, all if there are fewer.

    Both sides are ``id long, terms array<int>, weights array<double>``.
    """
    columns = ["id", "terms", "weights"]
    typed = [F.col("id").cast("long").alias("id"), F.col("terms").cast("array<int>").alias("terms"), F.col("weights").cast("array<double>").alias("weights")]
    rows, queries = (written(df.select(*typed).filter("id IS NOT NULL"), "sparse") for df in (rows, queries))
    spark = rows.sparkSession
    n_blocks = max(1, -(-queries.count() // QUERIES))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_rows = rows.count()
    n_groups = max(1, -(-n_rows // GROUP_ROWS), min(-(-wanted // n_blocks), -(-n_rows // ROWS)))
    own = lambda n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(own(n_blocks).alias("block"), every(n_groups).alias("grp"), F.lit(0).alias("kind"), *columns)
    right = rows.select(every(n_blocks).alias("block"), own(n_groups).alias("grp"), F.lit(1).alias("kind"), *columns)
    cells = left.unionByName(right).repartition(n_blocks * n_groups, "block", "grp").sortWithinPartitions("block", "grp", "kind")
    found = cells.mapInArrow(_cells(k), "query_id long, vec_id long, score long")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
