"""Snapshot-based public-finance analytics on Spark DataFrames."""
