"""Operators on cells: DataFrame in, DataFrame out, keyed by file and sheet."""
