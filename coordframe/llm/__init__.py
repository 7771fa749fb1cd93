"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator is a plain function from
DataFrames to DataFrames; ``queries`` holds the registered queries and their SQL.
"""
