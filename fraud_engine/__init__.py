"""Card-transaction fraud analytics as Spark DataFrame jobs."""
