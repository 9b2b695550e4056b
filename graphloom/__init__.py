"""Weighted-graph analytics on PySpark DataFrames."""
