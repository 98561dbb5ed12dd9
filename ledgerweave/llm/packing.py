"""Best-fit packing of token sequences with certified bin counts.

Pieces are dealt into partitions of about ``PART`` pieces. Each is packed by best-fit decreasing, and dual feasible
functions give a lower bound on the sequences that its pieces need. Where the packing uses no more than the bound it is
certified. What is left over, the partition's emptiest sequences (more of them if it has a gap to its bound), is released;
every ``FAN`` partitions pool what they released and pack it again, until one pool is left. A pool keeps the new packing
only if it needs fewer sequences. Pools stay small because a partition releases a fixed number of sequences at most.

Defined results: NULL text is packed like an empty one, as its end mark alone; an empty table gives no row; rows with a
repeated or NULL doc_id are packed row by row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import CACHE, batches, words_of, written
from ledgerweave.llm.token_counts import byte_letters

CAPACITY = 2048
PART = 20_000
FAN = 8
RELEASED = 24  # sequences that a partition hands on, at most

# Latin-1 words without a special token's bracket: here Python's lower case and letter classes are the library's.
_SIMPLE = regex.compile(r"[\x21-;=-~¡-ÿ]+")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordIds(dict):
    """Little-endian 32-bit ids of each distinct white-space separated word under a lower-casing word-level BPE.

    Such a tokenizer drops white space and cuts at it, so a text's ids are those of its words, one after another. Words
    outside Latin-1 and possible special tokens are left to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if text.isascii() and text.isprintable() and "<" not in text:
            low = text.lower()
            # A printable ASCII letter stands for its own byte.
            ids = [t.id for p in ((low,) if low.isalpha() else _ASCII_PARTS.findall(low)) for t in self.model.tokenize(p)]
        elif _SIMPLE.fullmatch(text):
            parts = _PARTS.findall(text.lower())
            ids = [t.id for p in parts for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.table))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        value = np.array(ids, "<u4").tobytes()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> bytes:
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, words))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian 32-bit) of every row's pieces."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(path)
        end = np.array([end_id], "<u4").tobytes()

        def rows():
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = known.of(words_of(text)) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        row = doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)
                        yield (*row, own) if with_ids else row

        yield from batches(schema, rows())

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def lower_bound(counts: np.ndarray) -> int:
    """Bins of size ``len(counts) - 1`` that ``counts[x]`` items of each size ``x`` need at least.

    The best of two families of dual feasible functions: for a small size e, items above C - e count as a whole bin and
    those below e as nothing; for a whole k, items count as floor((k + 1) x / C) / k unless (k + 1) x / C is whole.
    """
    size = len(counts) - 1
    x = np.arange(size + 1)
    total = np.cumsum(counts * x)
    number = np.cumsum(counts)
    best = -(-int(total[-1]) // size)
    e = np.arange(1, size // 2 + 1)
    # Items over C - e, then the sum of those from e to C - e.
    large = number[-1] - number[size - e]
    middle = total[size - e] - total[e - 1]
    best = max(best, int(np.max(large + -(-middle // size), initial=0)))
    for k in range(1, 33):
        whole = (k + 1) * x % size == 0
        value = np.where(whole, x * k, (k + 1) * x // size * size)  # in parts of size * k
        best = max(best, -(-int((counts * value).sum()) // (size * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item. The fullest bin that has room is found in a bit set of the free capacities."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, count = 0, 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = some >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            bin_ = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, bin_, count = capacity, count, count + 1
        bins[i] = bin_
        room -= length
        free[room].append(bin_)
        some |= 1 << room
    return bins


_STATE = "item long, length long, bin long, open boolean, grp long"


def _repack(capacity: int, turn: int, last: bool):
    """Packs one pool. ``bin`` is NULL in the first turn; afterwards it numbers the released sequences."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        table = table.sort_by("item")  # the same result in whatever order rows arrive
        item, length = table["item"].to_numpy(), table["length"].to_numpy()
        bins = best_fit_decreasing(length, capacity)
        if turn:
            _, before = np.unique(table["bin"].to_numpy(), return_inverse=True)
            if before.max() <= bins.max():
                bins = before
        n = int(bins.max()) + 1
        fill = np.bincount(bins, weights=length, minlength=n)
        gap = n - lower_bound(np.bincount(length, minlength=capacity + 1))
        # A certified partition hands on only what a better mix of neighbours could still use.
        release = 0 if last else min(n, RELEASED if gap else RELEASED // 2)
        opened = np.zeros(n, bool)
        opened[np.argsort(fill, kind="stable")[:release]] = True
        opened &= fill < capacity
        number = (np.int64(turn) << 58) + (np.int64(grp) << 24) + bins
        return pa.table({"item": item, "length": length, "bin": number, "open": opened[bins], "grp": np.full(len(item), grp)})

    return run


def place(items: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """``item, sequence_id, offset`` for every row of ``items`` (``item`` unique, ``length`` 1 to ``capacity``)."""
    whole = items.filter(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // part))
    state = rest.select("item", "length", F.lit(None).cast("long").alias("bin"), F.lit(True).alias("open"), F.pmod(F.xxhash64("item"), F.lit(groups)).alias("grp"))
    closed, turn = None, 0
    while True:
        last = groups == 1
        state = written(state.groupBy("grp").applyInArrow(_repack(capacity, turn, last), _STATE), "pool")
        done = state.filter("NOT open").select("item", "length", "bin")
        closed = done if closed is None else closed.unionByName(done)
        if last:
            break
        turn, groups = turn + 1, -(-groups // FAN)
        state = state.filter("open").withColumn("grp", F.floor(F.col("grp") / FAN))
    spread = closed.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("row"))  # at most ``capacity`` items
    starts = F.transform("row", lambda x, i: F.struct(x["item"].alias("item"), F.aggregate(F.slice("row", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["length"]).alias("offset")))
    placed = spread.select(F.col("bin").alias("sequence_id"), F.inline(starts))
    return placed.select("item", "sequence_id", "offset").unionByName(whole)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, part: int = PART) -> DataFrame:
    """Pieces of all rows with their sequence and their place in it."""
    # Item numbers are pinned by writing the table; they need not agree between runs.
    cut = written(pieces(docs, path, capacity, end_id, with_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return cut.join(place(cut.select("item", "length"), capacity, part), "item").drop("item")
