"""Narrative time analytics on Spark DataFrames."""
