"""Relational operators over a Ledger: DataFrames in, DataFrames out."""
