"""Citation provenance analytics on Spark DataFrames."""
