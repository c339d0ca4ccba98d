"""Settlement reconciliation on Spark DataFrames."""
