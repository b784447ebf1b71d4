"""keylog: analytics over versioned key-value data, expressed as Spark DataFrames."""
