"""CSV and JSON scans under a schema contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv_contract(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header must equal the contract, column by column; anything else fails.

    Ledger files are text throughout, so the contract names text columns and casts come later. A
    blank cell is an empty text, never NULL.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .csv(path)
    )
    return rows.fillna("")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, pretty or compact, as one row."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
