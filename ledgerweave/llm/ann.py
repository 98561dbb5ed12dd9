"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact cosine.

Vectors are brought to length one. A table has ``hashes`` Gaussian projections, each cut into cells of width ``WIDTH`` at a
random shift; the cell numbers name a bucket. A query visits buckets of each table in the order of their estimated chance
to hold a neighbour: given a neighbour's cosine c, its projection is normal around c times the query's with deviation
sqrt(1 - c^2) times the projection's length. Perturbed cells are combined best first until the visited buckets hold a
neighbour with the chance that makes all tables together reach ``SUCCESS``. The cosine c comes from a bounded sample: the
lower end of the k-th nearest cosines, which the whole table can only raise.

Buckets and their visitors are cut into blocks of ``BLOCK`` vectors, so a bucket with a large part of all rows is many
small groups. Each group returns its best k for each visitor; the tables' candidates are merged and ranked.

Defined results: vectors that are NULL, empty, zero or hold a NULL or non-finite component take no part. Only vectors of
the same dimension are compared. A candidate with the query's own id is the query. Ties go to the smaller id; an id that
occurs in several rows counts once, with its best score. A query that finds fewer than k is compared with all buckets of a
table, which is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerweave.llm.common import written

TABLES = 3
WIDTH = 1.3  # of a cell, in deviations of the projection
SUCCESS = 0.975
BLOCK = 4096
SAMPLE_QUERIES, SAMPLE_ROWS = 200, 10_000
LOW = 0.1  # quantile of the sampled k-th cosines
MIN_HASHES, MAX_HASHES = 4, 12
SEED = 5


def vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, dim, v``: usable vectors as double arrays."""
    v = F.col(vec_col).cast("array<double>")
    picked = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return picked.filter((F.size("v") > 0) & good & F.exists("v", lambda x: x != 0)).select("id", F.size("v").alias("dim"), "v")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _projections(dim: int, table: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim, table))
    lines = rng.standard_normal((dim, hashes))
    return lines / np.linalg.norm(lines, axis=0) * math.sqrt(dim), rng.random(hashes) * WIDTH


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _names(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cell numbers."""
    name = np.full(len(cells), 17, np.int64)
    with np.errstate(over="ignore"):
        for column in cells.T:
            name = (name ^ column) * np.int64(0x100000001B3) + np.int64(7)
    return name


_SPOTS = pa.schema([("tab", pa.int32()), ("bucket", pa.int64()), ("dim", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])
_SPOTS_DDL = "tab int, bucket long, dim int, id long, v array<double>"


def _index(hashes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                mine = part.filter(pa.array(dims == dim))
                x = _unit(_matrix(mine.column("v"), dim))
                for table in range(TABLES):
                    lines, shift = _projections(dim, table, hashes)
                    names = _names(np.floor((x @ lines + shift) / WIDTH).astype(np.int64))
                    n = len(names)
                    yield pa.record_batch([pa.array(np.full(n, table, np.int32)), pa.array(names), pa.array(np.full(n, dim, np.int32)), mine.column("id"), mine.column("v")], schema=_SPOTS)

    return run


def cell_chances(spot: float, shift: float, cosine: float) -> list[tuple[float, int]]:
    """(chance, cell) of a neighbour's cell, likeliest first, for one projection ``spot`` of the query."""
    deviation = math.sqrt(max(1 - cosine * cosine, 1e-6))
    centre = cosine * spot + shift
    first, last = math.floor((centre - 4.5 * deviation) / WIDTH), math.floor((centre + 4.5 * deviation) / WIDTH)
    edge = [math.erf((c * WIDTH - centre) / deviation / math.sqrt(2)) / 2 for c in range(first, last + 2)]
    out = [(b - a, c) for a, b, c in zip(edge, edge[1:], range(first, last + 1), strict=False)]
    return sorted(out, key=lambda x: (-x[0], x[1]))


def probes(spots: list[float], shift: list[float], cosine: float, success: float) -> list[list[int]]:
    """Cells of the buckets to visit, in the order of their chance, until ``success`` is reached."""
    axes = [[(math.log(p), c) for p, c in cell_chances(s, h, cosine) if p > 1e-9] for s, h in zip(spots, shift, strict=True)]
    start = (0,) * len(axes)
    queue = [(-sum(a[0][0] for a in axes), start, 0)]
    out, reached = [], 0.0
    while queue and reached < success:
        cost, at, free = heapq.heappop(queue)
        out.append([a[i][1] for a, i in zip(axes, at, strict=True)])
        reached += math.exp(-cost)
        # Only axes from the last raised one on are raised, so every combination is made once.
        for j in range(free, len(axes)):
            if at[j] + 1 < len(axes[j]):
                heapq.heappush(queue, (cost + axes[j][at[j]][0] - axes[j][at[j] + 1][0], (*at[:j], at[j] + 1, *at[j + 1 :]), j))
    return out


def _visits(hashes: int, cosines: dict[int, float]):
    each = 1 - (1 - SUCCESS) ** (1 / TABLES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, vs = part.column("id"), part.column("v")
            dims = part.column("dim").to_pylist()
            for i, dim in enumerate(dims):
                x = _unit(_matrix(vs.slice(i, 1), dim))
                for table in range(TABLES):
                    lines, shift = _projections(dim, table, hashes)
                    names = _names(np.array(probes((x @ lines)[0].tolist(), shift.tolist(), cosines.get(dim, 0.0), each), np.int64))
                    n = len(names)
                    again = pa.array(np.zeros(n, np.int64))
                    yield pa.record_batch([pa.array(np.full(n, table, np.int32)), pa.array(names), pa.array(np.full(n, dim, np.int32)), ids.slice(i, 1).take(again), vs.slice(i, 1).take(again)], schema=_SPOTS)

    return run


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and exact score of each query's ``k`` best row ids, each id once with its best score."""
    ids, which = np.unique(row_ids, return_inverse=True)
    if len(ids) < len(row_ids):  # rows of one id stand together, equal ones once
        once = np.unique(np.column_stack([which.astype(np.float64), rows]), axis=0)
        which, rows = once[:, 0].astype(np.int64), once[:, 1:]
        row_ids = ids[which]
    rough = _unit(queries) @ _unit(rows).T
    rough[query_ids[:, None] == row_ids[None, :]] = -np.inf
    n = len(ids)
    top = np.maximum.reduceat(rough, np.searchsorted(which, np.arange(n)), axis=1) if n < len(row_ids) else rough
    least = np.partition(top, n - k, axis=1)[:, n - k] if n > k else np.full(len(rough), -np.inf)
    near = (rough >= least[:, None] - 1e-9) & (rough > -np.inf)
    if n < len(row_ids):
        near &= rough >= top[:, which] - 1e-9  # of an id only what can be its best
    q, r = np.nonzero(near)
    a, b = queries[q], rows[r]
    score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    order = np.lexsort((row_ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    if n < len(row_ids):
        first = np.sort(np.unique(np.column_stack([q, row_ids[r]]), axis=0, return_index=True)[1])
        q, r, score = q[first], r[first], score[first]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return query_ids[q[keep]], row_ids[r[keep]], score[keep]


_FOUND_DDL = "query_id long, vec_id long, score double"


def _meet(k: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, visitors: pa.Table) -> pa.Table:
        if not len(rows) or not len(visitors):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dim = rows["dim"][0].as_py()
        x, y = _matrix(visitors["v"].combine_chunks(), dim), _matrix(rows["v"].combine_chunks(), dim)
        found = best(x, visitors["id"].to_numpy(), y, rows["id"].to_numpy(), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    return run


def _compared(rows: DataFrame, visitors: DataFrame, k: int) -> DataFrame:
    """Compare rows with visitors of the same ``tab, bucket, dim``, in blocks of both."""
    keys = ["tab", "bucket", "dim"]
    parts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    grid = written(parts(rows, "nr").join(parts(visitors, "nv"), keys), "grid")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = rows.join(grid, keys).withColumn("br", own("nr")).withColumn("bv", spread("nv"))
    right = visitors.join(grid, keys).withColumn("bv", own("nv")).withColumn("br", spread("nr"))
    names = [*keys, "br", "bv"]
    pick = lambda df: df.select(*names, "id", "v")
    return pick(left).groupBy(*names).cogroup(pick(right).groupBy(*names)).applyInArrow(_meet(k), _FOUND_DDL)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sampled_cosines(rows: DataFrame, k: int) -> dict[int, float]:
    """For each dimension in a bounded sample of ids, one vector each, a low quantile of its k-th nearest cosines."""
    drawn = [F.xxhash64("id", F.lit(SEED)), F.col("id")]
    picked = rows.join(F.broadcast(rows.select("id").distinct().orderBy(*drawn).limit(SAMPLE_ROWS)), "id", "left_semi")
    once = picked.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x"))
    sample = once.orderBy(*drawn).select("id", "x.dim", "x.v").limit(SAMPLE_ROWS).toArrow()
    out = {}
    dims = sample["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        x = _unit(_matrix(sample.filter(pa.array(dims == dim))["v"].combine_chunks(), dim))
        near = x[:SAMPLE_QUERIES] @ x.T
        near[np.arange(len(near)), np.arange(len(near))] = -1
        kth = np.sort(near, axis=1)[:, -min(k, near.shape[1])]
        out[dim] = float(np.clip(np.quantile(kth, LOW), 0.0, 0.999))
    return out


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest of ``rows`` that the probes find. Both from ``vectors``."""
    rows = written(rows, "vectors")
    queries = written(queries, "queries")
    n = rows.count()
    hashes = int(np.clip(math.ceil(math.log(max(n, 1) / BLOCK + 1) / math.log(3)), MIN_HASHES, MAX_HASHES))
    index = written(rows.select("id", "dim", "v").mapInArrow(_index(hashes), _SPOTS_DDL), "index")
    visits = written(queries.select("id", "dim", "v").repartition("id").mapInArrow(_visits(hashes, sampled_cosines(rows, k)), _SPOTS_DDL), "visits")
    found = written(_compared(index, visits, k), "found")
    # The few queries whose buckets hold too little see every bucket of one table.
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= k)
    short = queries.join(enough, F.col("id") == F.col("query_id"), "left_anti")
    if not short.isEmpty():
        one = index.filter("tab = 0")
        everywhere = written(short.join(one.select("tab", "bucket", "dim").distinct(), "dim").select("tab", "bucket", "dim", "id", "v"), "everywhere")
        found = found.unionByName(_compared(one, everywhere, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
