"""Quality rules: word statistics, then a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Two multinomials over hashed word features are compared: the raw one counts every document of the corpus, the trusted one
counts a bounded sample of labelled good documents. A document's score is the mean log ratio over its features, so long
and short texts are on one scale. The threshold is fixed from labelled documents that the trusted counts did not see, and
every document is judged by it: nothing is drawn at random.

The ratio of a feature is log((c + A) / (e + A)) with c its trusted count and e its expected count if trusted text were
like the raw corpus. Features too rare to tell have a ratio near 0 instead of a large negative one.

A mean dilutes a few bad words in a long text. So a second score adds up, over a text's distinct bare words, by how much
each log ratio lies below ``-STRONG``; it has a threshold of its own. Both thresholds together may cost ``GOOD_LOST`` of the
good documents that fix them.

Defined results: NULL or empty text has 0 words and fails the base rules; rows with a repeated or NULL doc_id are judged
row by row; labels with a NULL id or quality are not used; without any good label every document that passes the base
rules is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import CACHE, WordHashes, batches, mixed, windows, words_of, written

BUCKETS_LOG2 = 17  # hashed features of each of three kinds
LABELLED = 20_000  # labelled documents that are looked at, at most: those with the smallest hash of their id
SMOOTH = 10.0  # the A above
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words that may stand in repeated windows
WINDOW = 5
GOOD_LOST = 0.005  # share of good calibration documents that the thresholds may cost
STRONG = 1.2  # from this log ratio below 0 on a word counts by itself

_SYMBOLS = b"#*$%&|<>"
_EDGES = b".,;:!?\"'()"


@dataclass
class Ratios:
    """Weight of each hashed feature, and the smallest mean weight and sum of strong words of a kept document."""

    weights: np.ndarray
    threshold: float
    strong: float


class BareHashes(dict):
    """Hash of the bare lower-case form of each distinct word, which is made once per worker while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower().strip(_EDGES))
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def features(words: list[bytes], own: np.ndarray, plain: BareHashes) -> np.ndarray:
    """Buckets of a text's words as they stand (hashes ``own``), of its bare lower-case words and of pairs of those, one kind after another."""
    if not words:
        return np.empty(0, np.int64)
    bare = plain.of(words)
    kinds = [mixed(own), mixed(bare + np.uint64(1)), windows(bare, 2)]
    # Each kind has buckets of its own: the many rare pairs would blur the words.
    return np.concatenate([(x >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64) + (k << BUCKETS_LOG2) for k, x in enumerate(kinds)])


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
    total = np.zeros(3 << BUCKETS_LOG2, np.int64)
    hashes, plain = WordHashes(), BareHashes()
    for part in parts:
        for text in part.column(0).to_pylist():
            words = words_of(text)
            np.add.at(total, features(words, hashes.of(words), plain), 1)
    at = np.nonzero(total)[0]
    if len(at):
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)


def feature_counts(texts: DataFrame) -> np.ndarray:
    """Feature counts of a one-column frame of texts, summed in Spark; the result has a fixed size."""
    rows = texts.mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(3 << BUCKETS_LOG2, np.float64)
    total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return total


def _score(weights: np.ndarray, words: list[bytes], own: np.ndarray, plain: BareHashes) -> tuple[float, float]:
    """Mean weight of a text's features, and the sum over its strong words."""
    if not words:
        return 0.0, 0.0
    found = features(words, own, plain)
    each = weights[found]
    bare = slice(len(words), 2 * len(words))
    strong = np.unique(found[bare][each[bare] < -STRONG])
    return float(each.mean()), float((weights[strong] + STRONG).sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Ratios:
    """Ratios from all of ``docs`` and at most ``labelled`` of its labelled documents.

    Even hashes of the id fit the trusted multinomial, odd ones fix the threshold.
    """
    spark = docs.sparkSession
    raw = feature_counts(docs.select(F.col(text_col).cast("string")))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), "quality", "toxic")
        .filter("_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("_id")
        .agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
        .withColumn("_h", F.xxhash64("_id"))
        .orderBy("_h", "_id")
        .limit(labelled)
    )
    # At most ``labelled`` ids, so their broadcast has a fixed bound.
    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "_id")
    picked = written(picked.select("text", "good", (F.pmod("_h", F.lit(2)) == 0).alias("fits")), "labelled")
    trusted = feature_counts(picked.filter("good AND fits").select("text"))
    expected = raw * (trusted.sum() / max(raw.sum(), 1.0))
    weights = np.log((trusted + SMOOTH) / (expected + SMOOTH)).astype(np.float32)
    if not trusted.any():
        return Ratios(np.zeros_like(weights), -np.inf, -np.inf)
    shared = spark.sparkContext.broadcast(weights)

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, plain = WordHashes(), BareHashes()
        schema = pa.schema([("good", pa.bool_()), ("score", pa.float64()), ("strong", pa.float64())])
        rows = ((g, words_of(t)) for p in parts for t, g in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True))
        yield from batches(schema, ((g, *_score(shared.value, words, hashes.of(words), plain)) for g, words in rows))

    rows = picked.filter("NOT fits").select("text", "good").mapInArrow(scored, "good boolean, score double, strong double").toArrow()
    return Ratios(weights, *thresholds(rows["score"].to_numpy(), rows["strong"].to_numpy(), rows["good"].to_numpy(zero_copy_only=False)))


def thresholds(scores: np.ndarray, strong: np.ndarray, good: np.ndarray, lost: float = GOOD_LOST) -> tuple[float, float]:
    """The cut of the means, at half of what may be lost, then the cut of the strong words at what is left of it."""
    first = threshold(scores, good, lost / 2)
    left = scores >= first
    gone = (good & ~left).sum() / max(good.sum(), 1)
    return first, threshold(strong[left], good[left], max(lost - gone, 0.0))


def threshold(scores: np.ndarray, good: np.ndarray, lost: float = GOOD_LOST) -> float:
    """The cut with the best balanced accuracy among those that lose at most ``lost`` of the good documents.

    Between two neighbouring scores the cut lies in the middle, the lower cut wins a tie.
    """
    if not good.any():
        return -np.inf
    most = np.quantile(scores[good], lost)
    if good.all():
        return float(most)
    at = np.unique(scores)
    cuts = np.concatenate([[-np.inf], (at[1:] + at[:-1]) / 2])
    cuts = cuts[cuts <= most]
    below_bad = np.searchsorted(np.sort(scores[~good]), cuts) / (~good).sum()
    below_good = np.searchsorted(np.sort(scores[good]), cuts) / good.sum()
    return float(cuts[np.argmax(below_bad - below_good)])


def statistics(text: str | None, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    if not words:
        return 0, 0, 0, 0, 0
    raw = b"".join(words)
    # A code point is a byte that does not continue another.
    chars = int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    symbols = sum(raw.count(s) for s in (bytes([b]) for b in _SYMBOLS))
    lines = [x for x in text.split("\n") if words_of(x)]
    n = len(words)
    repeated = 0
    if n >= WINDOW:
        _, which, times = np.unique(windows(ids, WINDOW), return_inverse=True, return_counts=True)
        starts = np.nonzero(times[which] > 1)[0]
        if len(starts):
            marks = np.zeros(n + 1, np.int64)
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(marks[:-1])))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def judge(docs: DataFrame, ratios: Ratios, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, score and verdict of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((ratios.weights, ratios.threshold, ratios.strong))
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, least, least_strong = shared.value
        hashes, plain = WordHashes(), BareHashes()

        def rows():
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    own = hashes.of(words)
                    found = statistics(text, words, own)
                    failed = found[0] < LEAST_WORDS or 100 * found[4] > MOST_REPEATED * found[0]
                    score, strong = _score(weights, words, own, plain)
                    yield doc_id, *found, failed, not failed and score >= least and strong >= least_strong, score

        yield from batches(schema, rows())

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    )
