"""Product-catalog analytics expressed as Spark DataFrame jobs."""
