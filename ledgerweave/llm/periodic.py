"""Periodic runs of words, found by an online sparse diagonal DP.

A cell of the DP is a pair (word, earlier occurrence); their distance is the lag, and cells of one lag lie on a diagonal. A
word whose earlier occurrence continues the diagonal raises that lag's match length by one; the first word that does not ends
the diagonal, which then is a run of period ``lag`` and emitted at once if it is long enough.

Sparse means that most earlier occurrences are never visited, and none that could matter is left out. A run of smallest
period q has at least four periods. Let L be the power of two with L/2 < q <= L. Any L words inside the run stood there q words
before and, as q is its smallest period, not more lately: two shifts within L words would have a common divisor as a period.
So a word opens or continues the lag q exactly if the L words ending there have their latest earlier occurrence q words
before. Each size L therefore has one active lag at a word, whatever the text repeats, and a match length starts at L. The
sizes are visited upwards, each over those words only whose half-size neighbours both occur again, so plain text ends after
a few sizes, and a text that is one word repeated costs no more than any other.

Texts are taken together in blocks of ``BLOCK_WORDS`` words with word numbers of their own, so a cell never joins two texts. A
row is judged alone: no shuffle, no key that could be hot.

Defined results: NULL, empty and blank texts have no word, no run and an empty collapsed text. Repeated rows and NULL ids are
judged row by row. Words are compared byte by byte. A text is held whole by one task, with some 100 bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 1 << 18
BLOCK_DOCS = 4096
MIN_WORDS = 6  # of a run
MIN_PERIODS = 4

Run = tuple[int, int, int]  # start, length, period


def _swept(places: list[int], lags: list[int], size: int) -> list[Run]:
    """The diagonals of one size: cells in word order, one active lag with its match length."""
    out: list[Run] = []
    active, matched, last = 0, 0, -2
    for place, lag in zip([*places, -9], [*lags, 0], strict=True):
        if lag == active and place == last + 1:
            matched += 1
        else:
            length = matched + active
            if length >= max(MIN_WORDS, MIN_PERIODS * active):
                out.append((last + 1 - length, length, active))
            active, matched = lag, size
        last = place
    return out


def diagonal_runs(words: np.ndarray, longest: int) -> list[Run]:
    """Runs of a row of word numbers; ``longest`` is the number of words of its longest text.

    Texts that follow each other have no number in common. Runs come by size of their period, then by start.
    """
    out: list[Run] = []
    size, at, name = 1, np.arange(len(words)), words
    while True:
        order = np.argsort(name, kind="stable")
        again = np.diff(name[order]) == 0
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][again]] = (at[order[1:]] - at[order[:-1]])[again]
        cells = np.flatnonzero((lag > size // 2) & (lag <= size))
        out += _swept(at[cells].tolist(), lag[cells].tolist(), size)
        if MIN_PERIODS * (size + 1) > longest:
            return out
        # The next size: both halves occur more than once.
        often = np.zeros(len(at), bool)
        often[order[1:][again]] = True
        often[order[:-1][again]] = True
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ~again])) if len(at) else 0
        full = np.full(len(words), -1, np.int64)
        full[at[often]] = rank[often]
        at = at[often & (at >= size)]
        at = at[full[at - size] >= 0]
        if not len(at):
            return out
        name = full[at - size] * len(words) + full[at]
        size *= 2


_OUT = pa.schema([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def _judged(texts: list[list[bytes]]) -> list[tuple[list[Run], bytes]]:
    numbers: list[np.ndarray] = []
    base = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        numbers.append(np.fromiter((seen.setdefault(w, base + len(seen)) for w in words), np.int64, len(words)))
        base += len(seen)
    starts = np.cumsum([0, *map(len, texts)])
    found: list[list[Run]] = [[] for _ in texts]
    if base:
        for start, length, period in diagonal_runs(np.concatenate(numbers), max(map(len, texts))):
            doc = int(np.searchsorted(starts, start, side="right")) - 1
            found[doc].append((start - int(starts[doc]), length, period))
    return [(own := sorted(runs, key=lambda r: (r[0], r[2])), _collapsed(words, own)) for words, runs in zip(texts, found, strict=True)]


def _batch(keep: list[pa.Array], results: list[tuple[list[Run], bytes]], names: list[str]) -> pa.RecordBatch:
    runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in results], _OUT.field("runs").type)
    return pa.record_batch([*keep, runs, pa.array([c for _, c in results], pa.binary()).cast(pa.string())], names=[*names, "runs", "collapsed"])


def _find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        names = part.schema.names[:-1]
        first, words = 0, 0
        held: list[list[bytes]] = []
        texts = part.column(len(names)).cast(pa.binary()).to_pylist()
        for i, text in enumerate(texts):
            held.append((text or b"").split())
            words += len(held[-1])
            if words >= BLOCK_WORDS or len(held) >= BLOCK_DOCS or i + 1 == len(texts):
                yield _batch([part.column(n).slice(first, len(held)) for n in names], _judged(held), names)
                first, words, held = i + 1, 0, []


def find_runs(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, its ``runs`` (``start, length, period``, by start, then period) and ``collapsed``,
    the text's words without those that repeat a run's first period. ``keep`` holds no column named like these two.
    """
    picked = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(_find, f"{fields}{', ' if keep else ''}runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length over period, of equals the first; NULL if there is none."""
    better = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    return F.reduce(runs, F.get(runs, 0), lambda best, run: F.when(better(best, run), run).otherwise(best))
