"""Line deduplication across documents by pairwise alignment.

A run is a line grown forwards, or backwards, by the lines beside it until it holds ``BLOCK_WORDS`` words; it begins and
ends with a line that has words. A run that several documents hold is owned by the earliest of them (smallest doc_id), and
every later holder is paired with the owner, so a run shared by n documents makes n - 1 pairs, however frequent or short its
lines are. Each word of a block that two documents share stands in a run inside the block, so no block is left out. Each
pair's line sequences are aligned with patience diff: lines that occur once in both are matched in a longest increasing run,
and the stretches between are aligned the same way, until the alignment finds no common block any more. Blocks with at least
``BLOCK_WORDS`` words are deleted from the later document, and so are the owner's runs that the alignment passed over because
they stand in another order between other matches.

Only hashes move until the last step: a pair carries two lists of 8-byte line hashes.

Defined results: a NULL text stays NULL and an empty one empty. Lines are compared without white space at their ends;
blank lines match but find no pair. So a line with words is deleted just if it stands in a row of consecutive lines with
``BLOCK_WORDS`` words or more that an earlier document has as well; blank lines go with an aligned block. Rows with the same doc_id are never "later" than each other; equal rows get equal
results. Rows with a NULL doc_id are returned unchanged. A document whose lines are all deleted keeps an empty text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import batches, mixed, words_of, written

BLOCK_WORDS = 8  # words of the shortest block that is deleted

_FACTOR = 0x9E3779B97F4A7C15
_BACK = pow(_FACTOR, -1, 1 << 64)


def runs(lines: list[int], words: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the runs that each line with words begins and of those that it ends."""
    own = np.array(words, np.int64)
    upto = np.concatenate([[0], np.cumsum(own)])
    full = np.nonzero(own)[0]
    ends = np.searchsorted(upto, upto[full] + BLOCK_WORDS)
    starts = np.searchsorted(upto, upto[full + 1] - BLOCK_WORDS, side="right") - 1
    first, last = ends <= len(own), starts >= 0
    starts, ends = np.concatenate([full[first], starts[last]]), np.concatenate([ends[first], full[last] + 1])
    # Differences of prefix sums, shifted back to the same power: any length costs the same.
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(own), _FACTOR, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(own), _BACK, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(np.array(lines, np.int64).view(np.uint64)) * power[:-1])])
    return starts, ends, mixed((total[ends] - total[starts]) * back[starts]).view(np.int64)


def matched(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment of two sequences: matched positions, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        if not place:  # only repeated lines are common: their first places serve as anchors
            for i, x in enumerate(a[a0:a1], a0):
                if x in in_b:
                    place.setdefault(x, i)
        once: dict[int, int] = {}
        for j, x in enumerate(b[b0:b1], b0):
            if x in place:
                once.setdefault(x, j)
        run = _rising([(place[x], j) for x, j in once.items()])
        last_a, last_b = a0, b0
        for i, j in run:
            todo.append((last_a, i, last_b, j))
            out.append((i, j))
            last_a, last_b = i + 1, j + 1
        if run:
            todo.append((last_a, a1, last_b, b1))
    out.sort()
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run that rises in the first place; the second rises already."""
    tops: list[int] = []
    heads: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tops, i)
        before.append(heads[at - 1] if at else -1)
        if at == len(tops):
            tops.append(i)
            heads.append(k)
        else:
            tops[at], heads[at] = i, k
    run, k = [], heads[-1] if heads else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


def common_lines(a: list[int], b: list[int], words: list[int]) -> list[int]:
    """Positions in ``b`` that lie in aligned common blocks of enough words (``words`` of each line of ``b``).

    What stays of ``b`` is aligned again until no block is found, so blocks that stand in another order go as well. Runs
    of ``a`` that the alignment passed over go with them.
    """
    out: list[int] = []
    rest = list(range(len(b)))
    while rest:
        gone: list[int] = []
        block: list[int] = []
        end = (-2, -2)
        for i, j in [*((i, rest[k]) for i, k in matched(a, [b[x] for x in rest])), (-9, -9)]:
            if (i, j) != (end[0] + 1, end[1] + 1):
                if sum(words[x] for x in block) >= BLOCK_WORDS:
                    gone += block
                block = []
            block.append(j)
            end = (i, j)
        if not gone:
            break
        out += gone
        lost = set(gone)
        rest = [x for x in rest if x not in lost]
    return sorted({*out, *_shared(a, b, words)})


def _shared(a: list[int], b: list[int], words: list[int]) -> list[int]:
    """Positions in ``b`` inside its runs that ``a`` holds."""
    known = dict(zip(b, words, strict=True))
    starts, ends, keys = runs(b, words)
    # A run of ``a`` with a line that ``b`` lacks is none of ``b``'s, wherever it ends.
    hit = np.isin(keys, runs(a, [known.get(x, BLOCK_WORDS) for x in a])[2])
    edges = np.bincount(starts[hit], minlength=len(b) + 1) - np.bincount(ends[hit], minlength=len(b) + 1)
    return np.nonzero(np.cumsum(edges))[0].tolist()


def _lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("runs", pa.list_(pa.int64()))])

    def rows():
        for part in parts:
            for doc_id, h, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                lines = [x.strip() for x in text.split("\n")]
                hashes, sizes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines], [len(words_of(x)) for x in lines]
                yield doc_id, h, hashes, sizes, np.unique(runs(hashes, sizes)[2])

    yield from batches(schema, rows())


def _cuts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("cut", pa.list_(pa.int32()))])

    def rows():
        for part in parts:
            for doc_id, h, lines, words, owner_lines in zip(*(c.to_pylist() for c in part.columns), strict=True):
                cut = common_lines(owner_lines, lines, words)
                if cut:
                    yield doc_id, h, cut

    yield from batches(schema, rows())


def cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, cut``: which lines (from 0) each text loses; ``h`` is the text's xxhash64."""
    text = F.col(text_col).cast("string")
    source = docs.filter(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    lined = written(source.mapInArrow(_lines, "doc_id long, h long, lines array<long>, words array<int>, runs array<long>").dropDuplicates(["doc_id", "h"]), "lines")
    held = lined.select("doc_id", "h", F.explode("runs").alias("run"))
    owners = held.groupBy("run").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.max("doc_id").alias("last"))
    owners = written(owners.filter(F.col("first.doc_id") < F.col("last")).select("run", F.col("first.doc_id").alias("owner"), F.col("first.h").alias("owner_h")), "owners")
    pairs = held.join(owners, "run").filter("owner < doc_id").select("doc_id", "h", "owner", "owner_h").distinct()
    first = lined.select(F.col("doc_id").alias("owner"), F.col("h").alias("owner_h"), F.col("lines").alias("owner_lines"))
    both = pairs.join(lined.drop("runs"), ["doc_id", "h"]).join(first, ["owner", "owner_h"]).select("doc_id", "h", "lines", "words", "owner_lines")
    found = both.mapInArrow(_cuts, "doc_id long, h long, cut array<int>")
    # A text has at most two owners a line, so its cuts stay small.
    return found.groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"))


def _without(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts, gone = [], []
        for text, cut in zip(part.column("_text").to_pylist(), part.column("_cut").to_pylist(), strict=True):
            if cut:
                drop = set(cut)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            texts.append(text)
            gone.append(len(cut or ()))
        rest = [part.column(n) for n in part.schema.names if n not in ("_text", "_cut")]
        names = [n for n in part.schema.names if n not in ("_text", "_cut")]
        yield pa.record_batch([*rest, pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=[*names, "text", "cut_lines"])


def dedup(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, then ``text`` without the deleted blocks and ``cut_lines``, their line count.

    ``keep`` holds neither the text nor a column named like one of the results.
    """
    gone = cuts(docs, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("cut").alias("_cut"))
    text = F.col(text_col).cast("string")
    rows = docs.select(*keep, F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))
    joined = rows.join(gone, ["_id", "_h"], "left").select(*keep, "_text", "_cut")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name in keep)
    return joined.mapInArrow(_without, f"{fields}, text string, cut_lines long")


def stage_rows(docs: DataFrame) -> DataFrame:
    """``documents`` after deduplication: texts that lost all their lines are gone with their rows."""
    out = dedup(docs, ["doc_id", "lang", "source"])
    left = out.filter((F.col("cut_lines") == 0) | (F.trim("text") != ""))
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


