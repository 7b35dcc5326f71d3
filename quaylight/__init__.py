"""Market-data analytics on Spark DataFrames."""
