"""Sequence-graph analytics on PySpark DataFrames."""
