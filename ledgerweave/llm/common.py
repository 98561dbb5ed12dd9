"""Helpers shared by the training-data operators.

Conventions of the whole folder: an operator selects the columns it names from its input and ignores all others,
so extra columns (also with names that the operator uses inside) never clash. NULL texts count as empty texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ledgerweave.session import shared_dir

#: What separates words: space and the control characters 9 to 13, which is also what ``bytes.split()`` uses.
WORD = r"[^\x20\x09-\x0D]+"
CACHE = 1_000_000  # entries of a worker's word cache before it is emptied; bounds memory, not results


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts the lineage and pins the rows, so later stages agree even if a task runs again on another executor.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes:
    """64-bit hash of each word. Looking it up takes longer than making it, and a table of words takes a worker's memory."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive items, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i in range(size):
        total = total * np.uint64(factor) + mixed(hashes[i : i + n] + np.uint64(i + 1))
    return mixed(total)


def batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``rows`` in the order of ``schema``."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, held: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
