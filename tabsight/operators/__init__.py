"""Operators: DataFrame in, DataFrame out (plus a fitted model where trained)."""
