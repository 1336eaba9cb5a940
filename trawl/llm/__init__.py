"""Operators for preparing training text: one module per operator, each on plain DataFrames."""
