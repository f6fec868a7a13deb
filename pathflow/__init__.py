"""Road-network flow and equilibrium analytics on Spark DataFrames."""
