"""Hybrid recommendation and vector search on Spark DataFrames."""
