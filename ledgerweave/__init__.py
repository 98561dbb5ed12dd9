"""Event-sourced asset-ledger analytics on PySpark DataFrames and Structured Streaming."""
