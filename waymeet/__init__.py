"""Road-traffic trajectory analytics on Spark DataFrames."""
