"""Change-data mirror operators on Spark DataFrames and Structured Streaming."""
