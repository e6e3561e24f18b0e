"""Contract-document analytics on Spark DataFrames."""
