"""Payment-network analytics on Spark DataFrames."""
