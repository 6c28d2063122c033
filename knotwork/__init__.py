"""Hybrid retrieval, link-graph analytics and corpus operators on Spark DataFrames."""
