"""A Spark-first analytics engine: operation chains, event analytics, insights, text search and tables."""
