"""Versioned entity analytics on Spark DataFrames."""
