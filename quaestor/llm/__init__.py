"""Operators of a training-data pipeline over tables of texts, pages and vectors.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` binds each of them to the standard tables.
"""
