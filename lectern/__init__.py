"""Document intelligence and study analytics on Spark DataFrames."""
