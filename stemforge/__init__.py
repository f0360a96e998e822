"""Topological fingerprints of folded sequences, and comparison of them, on Spark DataFrames."""
