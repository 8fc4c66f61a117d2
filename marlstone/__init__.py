"""Retrieval analytics over document and source-code collections, as Spark DataFrames."""
