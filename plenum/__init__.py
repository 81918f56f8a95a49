"""Hybrid search and transcript analytics on Spark DataFrames."""
