"""Analytics operators expressed with Spark DataFrames, SQL and Structured Streaming."""
