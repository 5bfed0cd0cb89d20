"""Ordered key-value analytics on Spark DataFrames."""
