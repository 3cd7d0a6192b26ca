"""Relational operators: DataFrames and parameters in, DataFrame out; each takes its clock as an argument."""
