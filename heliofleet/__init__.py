"""Solar-fleet analytics and passage retrieval as plain Spark DataFrame operators."""
