"""Relational algebra over systems of small boolean relations, on Spark DataFrames."""
