"""Explanations for differences between the groups of an aggregate query, on Spark DataFrames."""
