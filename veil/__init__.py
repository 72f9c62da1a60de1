"""Privacy and utility analytics on Spark DataFrames."""
