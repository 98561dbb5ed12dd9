"""From raw ``documents`` to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept; what it decides takes effect. All but the last return the columns
of ``documents``. Repeated rows that the mix makes on purpose are packed one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import language_id, line_dedup, mixing, neardup, packing
from ledgerweave.llm.queries import tokenizer_path
from ledgerweave.session import use_utc

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mixture that the documents stand for cannot be written in SQL: alignment, permutation and packing have no SQL form.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID. Texts without a letter and texts whose language stays ambiguous go; the others keep their columns."""
    use_utc(spark)
    rows = docs.select(*COLUMNS)
    found = language_id.predict(rows, language_id.fit(rows))
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup. Aligned common blocks go from the later document; a document that is nothing else goes as a whole."""
    return line_dedup.stage_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup at 80 %. Of each group one row stays: the document with the smallest id, once."""
    rows = docs.select(*COLUMNS)
    kept = neardup.classes(rows, percent=80).filter("kept AND doc_id IS NOT NULL AND n_shingles > 0").select(F.col("doc_id").alias("_kept")).distinct()
    same = ["doc_id", F.xxhash64("text").alias("_text")]
    judged = rows.filter(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    once = judged.withColumn("_text", same[1]).dropDuplicates(["doc_id", "_text"]).select(*COLUMNS)
    # Rows that the operator links with nothing: those without an id and those without words.
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return once.unionByName(rows.filter(F.col("doc_id").isNull() | blank))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing. Every row comes as often as the mix takes it; rows that it does not take go."""
    return mixing.stage_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens: one row a piece, as ``op3`` returns them."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each written and read again before the next."""
    from ledgerweave.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
