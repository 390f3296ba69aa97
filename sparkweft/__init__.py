"""Document memory and retrieval on Spark DataFrames."""
