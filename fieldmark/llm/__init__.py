"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; :mod:`fieldmark.llm.queries` binds each one to the tables.
"""
