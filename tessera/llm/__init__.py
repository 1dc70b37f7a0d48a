"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator is a plain function from
DataFrames to a DataFrame; ``queries.py`` holds the thin registered queries and ``oracles.py`` their SQL.
"""
