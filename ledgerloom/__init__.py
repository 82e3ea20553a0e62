"""A ledger analytics engine on Spark DataFrames."""
