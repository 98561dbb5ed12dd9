"""Token counts by distinct pre-token.

1. Each map task cuts its documents into pre-tokens and keeps, per block of documents, the distinct pre-tokens and how
   often each document has them (the per-document frequencies), packed by a bucket of the pre-token's hash.
2. All blocks' entries of one bucket meet in one place. There each distinct pre-token is given to the tokenizer once, and
   the number of its pieces is joined to the frequencies and summed into one number per document, block and bucket.
3. The buckets' sums are added up per block. No list of ids exists at any point.

A frequent pre-token appears once per block and bucket however many documents have it, so no key is hot.

Defined results: NULL or empty text has 0 tokens; rows with a repeated or NULL doc_id are counted row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_DOCS = 8192  # documents of a block at most; a slot number fits in 16 bits
BLOCK_CHARS = 1 << 24  # characters of a block, but for its last document

_PACKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("names", pa.binary()), ("freqs", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_PACKED_DDL = "block long, bucket int, names binary, freqs binary, docs array<long>, sizes array<long>"
_SUMS_DDL = "block long, sums binary, docs array<long>, sizes array<long>"
_SUMS = pa.schema([("block", pa.int64()), ("sums", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
# Beyond Latin letters the tables of two libraries may differ, so such texts are cut by the tokenizer itself.
_SIMPLE = regex.compile(r"[\x00-ɏ]*")


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies use for each byte: itself where it prints, else the next free from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(rest)}


class Pretokens:
    """Cuts texts where the tokenizer does; each part encodes alone to what it encodes to inside the text."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.table = byte_letters()

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of ``text``; a special token's string is a pre-token of its own, as the library's default has it."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = []
        for i, part in enumerate(self.special.split(text)):
            if part:
                parts += [part] if i % 2 else self._plain(part)
        return parts

    def _plain(self, text: str) -> list[str]:
        if _SIMPLE.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, names: list[str]) -> list[int]:
        """Number of pieces of each pre-token; the model alone is asked, as each name is one pre-token already."""
        model, table = self.tokenizer.model, self.table
        plain = self.special is None
        return [
            len(model.tokenize(n.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)))
            if plain or not self.special.fullmatch(n)
            else 1
            for n in names
        ]


def _pack(path: str, buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Pretokens(path)
        base = TaskContext.get().partitionId() << 32
        number = 0
        ids: list = []
        sizes: list[int] = []
        local: dict[str, int] = {}
        slots: list[np.ndarray] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            rows = [(base + number, None, None, None, list(ids), list(sizes))]
            if local:
                names = [n.encode("utf-8", "surrogatepass") for n in local]
                where = np.fromiter((xxhash.xxh3_64_intdigest(n) % buckets for n in names), np.int64, len(names))
                order = np.argsort(where, kind="stable")
                new = np.empty(len(order), np.int64)
                new[order] = np.arange(len(order))
                doc = np.repeat(np.arange(len(ids)), [len(s) for s in slots])
                pair, n = np.unique(new[np.concatenate(slots)] * BLOCK_DOCS + doc, return_counts=True)
                name, slot = pair // BLOCK_DOCS, pair % BLOCK_DOCS
                edges = np.searchsorted(where[order], np.arange(buckets + 1))
                cuts = np.searchsorted(name, edges)
                for b in range(buckets):
                    if edges[b] == edges[b + 1]:
                        continue
                    mine = [names[i] for i in order[edges[b] : edges[b + 1]]]
                    lengths = np.array([len(x) for x in mine], "<u4")
                    at = slice(cuts[b], cuts[b + 1])
                    freqs = ((name[at] - edges[b]).astype("<u4"), slot[at].astype("<u2"), n[at].astype("<u4"))
                    packed = np.array([len(mine)], "<u4").tobytes() + lengths.tobytes() + b"".join(mine)
                    rows.append((base + number, b, packed, b"".join(x.tobytes() for x in freqs), None, None))
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = text or ""
                found = cutter.cut(text)
                slots.append(np.fromiter((local.setdefault(x, len(local)) for x in found), np.int64, len(found)))
                ids.append(doc_id)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                chars += len(text)
                if len(ids) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    yield flush()
                    number, chars = number + 1, 0
                    ids, sizes, local, slots = [], [], {}, []
        if ids:
            yield flush()

    return run


def _sum(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Pretokens(path)
        known: dict[bytes, int] = {}
        for part in parts:
            rows = []
            for block, bucket, names, freqs, docs, sizes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if bucket is None:
                    rows.append((block, None, docs, sizes))
                    continue
                n = int.from_bytes(names[:4], "little")
                ends = 4 + 4 * n + np.cumsum(np.frombuffer(names, "<u4", n, 4), dtype=np.int64)
                starts = np.concatenate([[4 + 4 * n], ends[:-1]])
                mine = [names[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                new = [x for x in mine if x not in known]
                known.update(zip(new, cutter.pieces([x.decode("utf-8", "surrogatepass") for x in new]), strict=True))
                pieces = np.fromiter((known[x] for x in mine), np.int64, n)
                k = len(freqs) // 10
                name = np.frombuffer(freqs, "<u4", k)
                slot = np.frombuffer(freqs, "<u2", k, 4 * k)
                times = np.frombuffer(freqs, "<u4", k, 6 * k)
                sums = np.bincount(slot, weights=pieces[name] * times).astype("<u4")
                rows.append((block, sums.tobytes(), None, None))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMS, strict=True)], schema=_SUMS)

    return run


def _total(table: pa.Table) -> pa.Table:
    """One block: its header row and one row of partial sums for each bucket."""
    head = table.filter(table["docs"].is_valid())
    ids, sizes = head["docs"][0].as_py(), head["sizes"][0].as_py()
    total = np.zeros(len(ids), np.int64)
    for sums in table["sums"].to_pylist():
        if sums is not None:
            part = np.frombuffer(sums, "<u4")
            total[: len(part)] += part
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(total)})


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row's whole text under the tokenizer file ``path``.

    ``buckets``: parts of the pre-token dictionary, by default four for each shuffle partition, so it grows with the
    cluster's setting for the input.
    """
    spark = docs.sparkSession
    buckets = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pack(path, buckets), _PACKED_DDL)
    # Header rows carry no bucket; they are dealt by their block.
    meet = packed.repartition(F.coalesce(F.col("bucket").cast("long"), F.col("block")))
    sums = meet.mapInArrow(_sum(path), _SUMS_DDL)
    return sums.groupBy("block").applyInArrow(_total, "doc_id long, n_bytes long, n_tokens long")
