"""Sequence search and its analytics on Spark DataFrames."""
