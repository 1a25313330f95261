"""Time-series market analytics on Spark DataFrames."""
