"""Entity, attribute and relation analytics on Spark DataFrames."""
