"""Recursive rules, equality and term extraction over Spark DataFrames."""
