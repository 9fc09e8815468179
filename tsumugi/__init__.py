"""Dictionary lookup and text analytics on Spark DataFrames."""
