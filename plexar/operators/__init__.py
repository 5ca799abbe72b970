"""Relational, vector, graph and access-control operators over DataFrames."""
