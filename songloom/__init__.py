"""Song recommendation and catalog analytics on Spark DataFrames."""
