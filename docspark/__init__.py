"""Document-processing analytics on Spark DataFrames."""
