"""What a Python worker holds does not follow the number of rows or of distinct words."""

import sys

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ledgerweave.llm.common import WordHashes
from ledgerweave.llm.quality import BareHashes
from ledgerweave.session import use_utc


def test_batches_of_long_texts_are_small(spark):
    def sizes(parts):
        for part in parts:
            yield pa.record_batch([pa.array([part.num_rows]), pa.array([part.nbytes])], names=["n", "size"])

    texts = use_utc(spark).range(0, 6000, 1, 1).select(F.concat(F.repeat(F.lit("word "), 400), F.col("id").cast("string")).alias("t"))
    found = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 6000 and max(r["size"] for r in found) < 3_000_000


def test_hashes_hold_no_words():
    words = [b"%d" % i for i in range(20_000)]
    hashes = WordHashes()
    assert hashes.of(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words] and hashes.of([]).tolist() == []
    assert sys.getsizeof(hashes) < 1000
    assert BareHashes().of([b"Word,", b"word"]).tolist() == [xxhash.xxh3_64_intdigest(b"word")] * 2
