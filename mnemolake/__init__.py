"""Document-memory analytics on Spark DataFrames."""
