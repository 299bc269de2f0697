"""Small-business finance analytics as Spark DataFrames."""
