"""Operators of the context graph, as functions from DataFrames to DataFrames."""
