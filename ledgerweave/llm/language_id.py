"""Language identification with error-correcting output codes.

Each language has a codeword, a row of a Hadamard matrix, so any two differ in half of their bits. For every bit a binary
classifier over hashed letter n-grams tells the languages with a 1 from those with a 0: its weight for an n-gram is the log
ratio of the two groups' smoothed multinomials, each language counting alike. The multinomials are counted in one pass over
all training rows. A text's margin for a bit is the mean weight of its n-grams. Decoding adds up the logistic loss of the
margins against each codeword, each bit weighted by how reliably it recognises that language, and takes the codeword with
the least loss. A text is ambiguous if the second codeword is nearly as close.

Defined results: a text that is NULL or has no letter is ``und`` with score 0 and is not ambiguous; rows with a NULL label
are not learned from; with no training row at all every text is ``und``; rows with a repeated or NULL id are predicted row
by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BUCKETS_LOG2 = 16
ORDERS = (1, 2, 3)  # lengths of the n-grams
SMOOTH = 0.5
SHARPNESS = 8.0  # of the logistic loss over mean log ratios
CERTAINTY = 12.0  # of the score over loss differences
AMBIGUOUS = 0.02  # two codewords whose losses differ by less are both possible
UNKNOWN = "und"
PIECE = 1 << 20  # code points that are looked at together; longer texts are summed over pieces

_LETTERS = np.zeros(0, np.bool_)


def _letters() -> np.ndarray:
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    return _LETTERS


@dataclass
class Codes:
    """Languages, their codewords (+1 or -1), each bit's reliability for them, and each bit's n-gram weights."""

    langs: list[str]
    words: np.ndarray
    trust: np.ndarray
    weights: np.ndarray


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the letter n-grams of a whole text, piece by piece.

    The text is lower-cased, and each run of other characters becomes one space. Nothing for a text without a letter.
    """
    if not text:
        return
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of each run of other characters
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    for at in range(0, len(points), PIECE):
        part = points[at : at + PIECE + max(ORDERS) - 1]
        for order in ORDERS:
            n = min(len(part) - order + 1, PIECE)
            if n <= 0:
                continue
            total = np.full(n, order, np.uint32)
            for i in range(order):
                total = (total ^ part[i : i + n]) * np.uint32(0x9E3779B1)
                total ^= total >> np.uint32(15)
            yield (total * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS_LOG2)


def codewords(n: int) -> np.ndarray:
    """``n`` rows of the smallest Hadamard matrix that has them beside the constant row, without the constant column."""
    size = 8
    while size < n + 1:
        size *= 2
    h = np.array([[1]])
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:]


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    total: dict[str, np.ndarray] = {}
    for part in parts:
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for found in grams(text):
                if lang not in total:
                    total[lang] = np.zeros(1 << BUCKETS_LOG2, np.int64)
                total[lang] += np.bincount(found, minlength=1 << BUCKETS_LOG2)
    for lang, n in total.items():
        at = np.nonzero(n)[0]
        yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], schema=schema)


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Codes:
    """Learn from all ``rows`` with a label. What reaches the driver has a fixed size for each language."""
    counted = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    table = counted.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    if not langs:
        return Codes([], np.zeros((0, 1)), np.zeros((0, 1)), np.zeros((1 << BUCKETS_LOG2, 1), np.float32))
    number = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), 1 << BUCKETS_LOG2))
    counts[[number[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] = table["n"].to_numpy()
    share = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
    words = codewords(len(langs))
    # A bit that all languages share tells nothing.
    words = words[:, np.abs(words.sum(axis=0)) < len(langs)] if len(langs) > 1 else words[:, :1]
    ones = (words > 0).astype(float)
    rest = share.mean(axis=0)
    positive = np.where(ones.sum(axis=0)[:, None] > 0, ones.T @ share / np.maximum(ones.sum(axis=0), 1)[:, None], rest)
    negative = np.where((1 - ones).sum(axis=0)[:, None] > 0, (1 - ones).T @ share / np.maximum((1 - ones).sum(axis=0), 1)[:, None], rest)
    weights = np.log(positive / negative).T
    # The expected margin of a language's own text on the right side; a bit without one has no say for it.
    trust = np.maximum(words * (share @ weights), 0) + 1e-9
    return Codes(langs, words, trust / trust.sum(axis=1, keepdims=True), weights.astype(np.float32))


def decode(codes: Codes, margins: np.ndarray) -> tuple[str, float, bool]:
    """Language, score and ambiguity for one text's margins."""
    loss = (codes.trust * np.logaddexp(0, -SHARPNESS * codes.words * margins)).sum(axis=1)
    best = int(np.argmin(loss))
    odds = np.exp(-CERTAINTY * (loss - loss[best]))
    second = np.partition(loss, 1)[1] if len(loss) > 1 else np.inf
    return codes.langs[best], float(1 / odds.sum()), bool(second - loss[best] < AMBIGUOUS)


def _margins(codes: Codes, text: str | None) -> np.ndarray | None:
    total, n = np.zeros(codes.weights.shape[1]), 0
    for found in grams(text):
        total += np.bincount(found, minlength=0) @ codes.weights[: int(found.max()) + 1] if len(found) > 1 << 15 else codes.weights[found].sum(axis=0, dtype=np.float64)
        n += len(found)
    return total / n if n else None


def predict(docs: DataFrame, codes: Codes, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` that it selects by name, with ``lang_pred, score, ambiguous`` appended.

    Only the text is looked at. The other columns pass through Arrow unchanged; columns named like the three new ones are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(codes))
    new = ("lang_pred", "score", "ambiguous")
    kept = docs.drop(*new)
    at = kept.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Codes(**shared.value)
        for part in parts:
            rows = []
            for text in part.column(at).to_pylist():
                margins = _margins(model, text) if model.langs else None
                rows.append((UNKNOWN, 0.0, False) if margins is None else decode(model, margins))
            extra = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.bool_())]
            yield pa.record_batch([*part.columns, *extra], names=[*part.schema.names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")
