"""Relational SQL, vector search, property graphs, document collections and event analytics over Spark DataFrames."""
