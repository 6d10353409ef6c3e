"""trackspark: event-level time-series analytics on Spark DataFrames."""
