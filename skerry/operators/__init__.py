"""Operators over DataFrames: search, aggregation, change feeds, compaction, schema drift, incremental runs."""
