"""Operators for large training-text corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns
DataFrames; ``queries`` derives the digest columns of the registered queries from them.
"""
