"""Relational operators of the reconciliation engine: DataFrame in, DataFrame out."""
