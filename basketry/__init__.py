"""Purchase-event analytics on Spark DataFrames."""
