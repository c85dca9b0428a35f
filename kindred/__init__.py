"""Record linkage on Spark DataFrames."""
