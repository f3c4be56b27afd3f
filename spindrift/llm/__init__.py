"""Training-data operators: each takes and returns Spark DataFrames and works on whole tables."""
