"""A semantic analytics engine on Spark DataFrames."""
