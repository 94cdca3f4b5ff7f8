"""lodestream: analytics pipelines expressed as Spark DataFrame, SQL and Structured Streaming plans."""
