"""Operators on DataFrames of sequences, intervals and measurements."""
