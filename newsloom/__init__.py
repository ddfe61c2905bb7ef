"""News and narrative analytics on PySpark DataFrames, SQL and Structured Streaming."""
