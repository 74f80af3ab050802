"""Evidara: retrieval-with-evidence operators as lazy Spark DataFrames."""
