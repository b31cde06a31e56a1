"""Market-data analytics as Spark DataFrame jobs."""
