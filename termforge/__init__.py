"""Dictionary lookup, text annotation and dictionary analytics on Spark DataFrames."""
