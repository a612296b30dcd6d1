"""Operators of a training-data pipeline, each a function from DataFrames to DataFrames.

Nothing outside this folder imports it. ``queries`` lists the registered queries.
"""
