"""Batch retrieval, ranking and evaluation on Spark DataFrames."""
