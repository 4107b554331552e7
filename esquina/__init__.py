"""Batch and stream street geocoding on Spark DataFrames."""
