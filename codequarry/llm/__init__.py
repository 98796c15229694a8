"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator is a
function of DataFrames; ``queries`` holds the thin registered queries.
"""
