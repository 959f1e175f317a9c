"""Network-parameter analytics on Spark DataFrames."""
