"""Retrieval-augmented text analytics on Spark DataFrames."""
